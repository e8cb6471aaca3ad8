"""Checks of input rows: what is wrong with each, as a list of texts.

Spark's types settle what a value is; these columns settle what it may be.  A
row without a problem has an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import stripped
from tallyloom.functions.merchants import normalize_merchant

# What a transaction's direction and a document's type may be.
DIRECTIONS = ("outgoing", "incoming", "unknown")
DOCUMENT_TYPES = ("pdf", "jpg", "jpeg", "png")


def optional_text(value: Column) -> Column:
    """Without blanks at both ends; null where nothing is left."""
    return F.nullif(stripped(value), F.lit(""))


def currency_code(value: Column) -> Column:
    """Upper case without blanks around it; null where nothing is left."""
    return F.upper(optional_text(value))


def missing(name: str) -> Column:
    return F.when(optional_text(F.col(name)).isNull(), f"{name} is empty")


def one_of(name: str, values: tuple[str, ...]) -> Column:
    return F.when(~F.coalesce(F.col(name).isin(*values), F.lit(False)), f"{name} is not known")


def positive(name: str, required: bool = True) -> Column:
    good = F.coalesce(F.col(name) > 0, F.lit(not required))
    return F.when(~good, f"{name} is not greater than zero")


def currency_problem(name: str = "currency", required: bool = True) -> Column:
    good = F.coalesce(currency_code(F.col(name)).rlike(r"^\p{L}{3}$"), F.lit(not required))
    return F.when(~good, f"{name} is not a code of three letters")


def digest_problem(name: str) -> Column:
    good = F.coalesce(F.lower(optional_text(F.col(name))).rlike("^[0-9a-f]{64}$"), F.lit(True))
    return F.when(~good, f"{name} is not a SHA-256 digest")


def _normal_name_problem() -> Column:
    given, own = optional_text(F.col("merchant_normalized")), normalize_merchant(optional_text(F.col("merchant_raw")))
    return F.when(given.isNotNull() & ~given.eqNullSafe(own), "merchant_normalized is not the name's normal form")


def _of(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Checks of columns that the rows do not have are left out."""
    present = [check for name, check in checks.items() if name in rows.columns]
    return rows.withColumn("problems", F.array_compact(F.array(*present)))


def checked_transactions(rows: DataFrame) -> DataFrame:
    """Transactions with clean texts and codes, and their problems."""
    rows = _of(rows, {
        "id": missing("id"), "posted_date": F.when(F.col("posted_date").isNull(), "posted_date is missing"), "direction": one_of("direction", DIRECTIONS),
        "amount": positive("amount"), "currency": currency_problem(), "description": missing("description"), "source_file": missing("source_file"),
        "source_page": positive("source_page", required=False), "source_row": positive("source_row", required=False),
        "merchant_normalized": _normal_name_problem(),
    })
    return _cleaned(rows, ("id", "description", "merchant_raw", "merchant_normalized", "source_file"))


def checked_documents(rows: DataFrame) -> DataFrame:
    """Documents with clean texts and codes, and their problems."""
    rows = _of(rows, {
        "id": missing("id"), "filename": missing("filename"), "document_type": one_of("document_type", DOCUMENT_TYPES),
        "amount": positive("amount", required=False), "currency": currency_problem(required=False), "file_hash": digest_problem("file_hash"),
        "merchant_normalized": _normal_name_problem(),
    })
    return _cleaned(rows, ("id", "filename", "merchant_raw", "merchant_normalized", "invoice_number", "file_hash"))


def _cleaned(rows: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    clean = {name: optional_text(F.col(name)) for name in texts if name in rows.columns}
    return rows.withColumns(clean | ({"currency": currency_code(F.col("currency"))} if "currency" in rows.columns else {}))
