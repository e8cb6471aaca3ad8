"""Fields of documents from their text, as column expressions.

Every field follows one rule: find all candidates, parse them, and keep the
value only if exactly one different value is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import parse_amount
from tallyloom.functions.columns import let, lines_of, only, stripped
from tallyloom.functions.dates import parse_date, vote

# The patterns that tokens, labels and label words follow.
DATE_TOKEN = r"(?<!\d)(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)"
AMOUNT_TOKEN = r"(?U)[€£]\s*\d(?:[\d .,]*\d)?|\b[A-Za-z]{3}\s+\d(?:[\d .,]*\d)?|\d(?:[\d .,]*\d)?(?:\s+[A-Za-z]{3})?"
TOTAL_LINE = r"(?Udi)\b(?:amount due|grand total|total|summa|kopā|kopa|payable)\b"
MERCHANT_LINE = r"(?Udim)^[ \t]*(?:supplier|merchant|seller|vendor|piegādātājs|piegadatajs)[ \t]*[:\-][ \t]*(.+?)[ \t]*$"
INVOICE_TOKEN = (
    r"(?Udi)\b(?:invoice|inv|rēķina|rēķins|rekina|rekins)\b(?:[ \t]+(?:no|nr|number)\.?)?"
    r"(?:[ \t]*[:#][ \t]*|[ \t]+)([A-Za-z0-9\-/]*\d[A-Za-z0-9\-/]*)"
)


def issued_date(text: Column) -> Column:
    """The one valid date of a text."""
    return only(F.transform(F.regexp_extract_all(text, F.lit(DATE_TOKEN), F.lit(0)), parse_date))


def _amounts(lines: Column, bare: bool) -> Column:
    tokens = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(AMOUNT_TOKEN), F.lit(0))))
    if not bare:
        tokens = F.filter(tokens, lambda t: ~stripped(t).rlike(r"^\d+$"))
    parsed = F.filter(F.transform(tokens, parse_amount), lambda p: p["amount"].isNotNull())
    return F.transform(parsed, lambda p: F.struct(p["amount"].alias("amount"), p["currency"].alias("currency")))


def amount(text: Column) -> Column:
    """The one amount with its currency: of lines with a label of totals if
    there are any, else of all lines, where whole numbers do not count."""
    return let(
        lines_of(text),
        lambda lines: let(
            F.filter(lines, lambda x: x.rlike(TOTAL_LINE)),
            lambda totals: F.when(F.size(totals) > 0, only(_amounts(totals, True))).otherwise(only(_amounts(lines, False))),
        ),
    )


def _one_text(text: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), stripped)
    return only(F.filter(found, lambda v: v != ""))


def extract_fields(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Add issued_date, amount, currency, merchant_raw and invoice_number; what
    is absent or not unique is null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = texts.withColumn("issued_date", issued_date(text)).withColumn("money", amount(text))
    found = found.withColumn("amount", F.col("money.amount")).withColumn("currency", F.col("money.currency")).drop("money")
    return found.withColumn("merchant_raw", _one_text(text, MERCHANT_LINE)).withColumn("invoice_number", _one_text(text, INVOICE_TOKEN))


def found_invoices(files: DataFrame) -> DataFrame:
    """From files(scope_id, filename, text): the fields of each as an invoice,
    with the period that date, text and name agree on; a column place stays."""
    fields = extract_fields(files)
    period = vote(F.col("issued_date"), F.coalesce("text", F.lit("")), F.col("filename"))
    place = ["place"] if "place" in files.columns else []
    return fields.select("scope_id", "filename", *place, "invoice_number", "issued_date", period.alias("period"), "amount", "currency", F.col("merchant_raw").alias("supplier"))
