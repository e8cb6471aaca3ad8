"""Folders as they lie on a disk: a statement and the documents beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.references import document_id
from tallyloom.plans.extraction import extract_fields
from tallyloom.plans.reconcile import Reconciliation, match_transactions
from tallyloom.plans.statement import StatementError

# What names a bank statement, and how texts were read.
STATEMENT_NAME = r"(?Ui)kontaparskats|parskats|pārskats|statement"
METHODS = {"pdf": "pdf_text"}


def is_statement() -> F.Column:
    return (F.col("document_type") == "pdf") & F.col("filename").rlike(STATEMENT_NAME)


def pick_statements(files: DataFrame) -> DataFrame:
    """Of files(scope_id, rel_path, filename, document_type), for every folder:
    its statement, null where there is none, and a problem where there are
    several: scope_id, statement, problem."""
    named = F.array_sort(F.collect_list(F.when(is_statement(), F.struct("rel_path", "filename"))))
    folders = files.groupBy("scope_id").agg(named.alias("s"))
    listed = F.array_join(F.transform("s", lambda x: x["filename"]), ", ")
    return folders.select(
        "scope_id", F.when(F.size("s") == 1, F.element_at("s", 1)["rel_path"]).alias("statement"),
        F.when(F.size("s") > 1, F.concat(F.lit("several bank statements found: "), listed)).alias("problem"),
    )


def supporting(files: DataFrame, picks: DataFrame) -> DataFrame:
    """The files of folders with a statement, without the statement itself; a
    contract is one of them."""
    held = picks.where("statement is not null").select("scope_id", F.col("statement").alias("rel_path"))
    folders = files.join(held.select("scope_id"), "scope_id", "left_semi")
    return folders.join(held, ["scope_id", "rel_path"], "left_anti")


def build_documents(files: DataFrame) -> DataFrame:
    """Documents of files(scope_id, filename, document_type, content, text): the
    id is the hash of the bytes, not of the text, and fields come from the text."""
    read = extract_fields(files).withColumn("id", document_id(F.col("content")))
    method = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in METHODS.items() for x in (k, v)]), F.col("document_type")), F.lit("ocr"))
    return read.select(
        "scope_id", "id", "filename", "document_type", "issued_date", "merchant_raw", "amount", "currency", "invoice_number",
        F.coalesce("text", F.lit("")).alias("extracted_text"), method.alias("extraction_method"), F.col("id").alias("file_hash"),
    )


def audit_folders(files: DataFrame, transactions: DataFrame) -> Reconciliation:
    """Match the statements' transactions with the other files of their folders.

    Raises where a folder holds several statements.  Files with equal bytes in a
    folder are one document."""
    picks = pick_statements(files)
    if bad := picks.where("problem is not null").orderBy("scope_id").limit(1).collect():
        raise StatementError(bad[0]["problem"])
    documents = build_documents(supporting(files, picks)).dropDuplicates(["scope_id", "id"])
    return match_transactions(transactions, documents)
