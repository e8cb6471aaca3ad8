"""Reference tokens, ids and other text evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.config import MICRO
from tallyloom.functions.amounts import plain
from tallyloom.functions.columns import let, stripped


def compact(text: Column) -> Column:
    """Upper-case letters and digits only; empty for null."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def is_useful(token: Column, minimum: int) -> Column:
    """Long enough, and with a letter unless it has eight digits."""
    digits = token.rlike(r"^\p{Nd}+$")
    return (F.length(token) >= minimum) & F.when(digits, F.length(token) >= 8).otherwise(token.rlike(r"\p{L}"))


def reference_tokens(text: Column, minimum: int) -> Column:
    """The different useful tokens of a text, in order of appearance."""
    words = F.split(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda t: is_useful(t, minimum)))


def reference_signal(description: Column, invoice: Column, document_text: Column, minimum: int) -> Column:
    """A million when the transaction names the invoice or the document holds
    one of its tokens; 0 when the document has text; else null."""
    has = lambda c: c.isNotNull() & (c != "")
    joined = F.concat_ws(" ", F.when(has(invoice), invoice), F.when(has(document_text), document_text))
    return let(
        F.struct(compact(invoice).alias("i"), compact(joined).alias("d")),
        lambda x: F.when((x["i"] != "") & is_useful(x["i"], minimum) & F.contains(compact(description), x["i"]), F.lit(MICRO).cast("long"))
        .when(x["d"] == "", None)
        .when(F.exists(reference_tokens(description, minimum), lambda t: F.contains(x["d"], t)), F.lit(MICRO).cast("long"))
        .when((x["i"] != "") | has(document_text), F.lit(0).cast("long")),
    )


def _field(value: Column) -> Column:
    return F.concat(F.length(value), F.lit(":"), value)


def document_id(content: Column) -> Column:
    """SHA-256 of a file's bytes."""
    return F.sha2(content, 256)


def transaction_id(
    source_file: Column, posted: Column, direction: Column, amount: Column, currency: Column, description: Column, page: Column, row: Column
) -> Column:
    """SHA-256 over eight length-prefixed fields, one to a line."""
    parts = [
        source_file,
        F.date_format(posted, "yyyy-MM-dd"),
        F.lower(direction),
        plain(amount.cast("decimal(28,8)")),
        F.upper(currency),
        stripped(description),
        F.coalesce(page.cast("string"), F.lit("")),
        F.coalesce(row.cast("string"), F.lit("")),
    ]
    return F.sha2(F.concat_ws("\n", *map(_field, parts)), 256)
