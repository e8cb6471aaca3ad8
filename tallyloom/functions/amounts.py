"""Money in text: grammar, errors and plain notation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import let, stripped

MONEY = "decimal(28,8)"
TYPE = "struct<amount:decimal(28,8),currency:string,error:string>"
# Blanks that group digits, and signs that name a currency.
GROUP_BLANKS = "\u00a0\u202f\u2009"
SIGNS = {"€": "EUR", "£": "GBP"}


def _code(part: Column) -> Column:
    found = F.when(part == "", F.lit(None).cast("string"))
    for sign, code in SIGNS.items():
        found = found.when(part == sign, code)
    return found.otherwise(F.upper(part))


def _number(body: Column) -> Column:
    """The digits of a body as plain decimal text, or null where no form fits."""
    last_is_comma = F.regexp_replace(F.replace(body, F.lit("."), F.lit("")), ",", ".")
    last_is_point = F.replace(body, F.lit(","), F.lit(""))
    joined = F.replace(body, F.lit(" "), F.lit(""))
    one = F.replace(joined, F.lit(","), F.lit("."))
    return (
        F.when(body.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), last_is_comma)
        .when(body.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), last_is_point)
        .when(body.rlike(r"^(\d+|\d{1,3}( \d{3})+)[.,](?!\d{3}$)\d+$"), one)
        .when(body.rlike(r"^\d{1,3}(,\d{3}){2,}$|^\d{1,3}(\.\d{3}){2,}$"), F.regexp_replace(body, "[.,]", ""))
        .when(body.rlike(r"^(\d+|\d{1,3}( \d{3})+)$"), joined)
    )


def parse_amount(text: Column) -> Column:
    """A struct (amount, currency, error) of one amount in text.

    Accepted are the usual European and English groupings with an optional
    currency in front or behind.  Whatever is ambiguous is an error instead of
    a guess: a dollar sign, two currencies, one separator before three digits.
    Zero and negative amounts are invalid.  Null text gives a null struct.
    """
    fail = lambda message: F.struct(
        F.lit(None).cast(MONEY).alias("amount"), F.lit(None).cast("string").alias("currency"), F.lit(message).alias("error")
    )
    clean = stripped(F.translate(text, GROUP_BLANKS, "   "))

    def value(body: Column, currency: Column) -> Column:
        return let(
            _number(body).try_cast(MONEY),
            lambda n: F.when(n > 0, F.struct(n.alias("amount"), currency.alias("currency"), F.lit(None).cast("string").alias("error")))
            .when(body.rlike(r"^(\d+|\d{1,3}( \d{3})+)[.,]\d{3}$"), fail("ambiguous amount"))
            .otherwise(fail("invalid amount")),
        )

    def peeled(t: Column) -> Column:
        return let(
            F.regexp_extract(t, r"^(€|£|[A-Za-z]{3}(?=[\s\d]))", 1),
            lambda front: let(
                F.struct(_code(front).alias("front"), stripped(F.substring(t, F.length(front) + 1, F.length(t))).alias("rest")),
                lambda a: let(
                    F.struct(a["front"].alias("front"), a["rest"].alias("rest"), F.regexp_extract(a["rest"], r"(€|£|(?<=[\s\d])[A-Za-z]{3})$", 1).alias("back")),
                    lambda b: F.when(
                        b["front"].isNotNull() & (b["back"] != "") & (b["front"] != _code(b["back"])), fail("conflicting currency")
                    ).otherwise(
                        let(
                            stripped(F.substring(b["rest"], F.lit(1), F.length(b["rest"]) - F.length(b["back"]))),
                            lambda body: value(body, F.coalesce(b["front"], _code(b["back"]))),
                        )
                    ),
                ),
            ),
        )

    return let(
        clean,
        lambda t: F.when(t.isNull(), F.lit(None).cast(TYPE))
        .when(t.startswith("$") | t.endswith("$"), fail("ambiguous currency"))
        .otherwise(peeled(t)),
    )


def plain(amount: Column) -> Column:
    """Plain notation without trailing zeros, from a fixed-scale decimal."""
    return F.regexp_replace(amount.cast("string"), r"\.?0+$", "")


def currency_safe_equal(a: Column, a_currency: Column, b: Column, b_currency: Column, tolerance: str = "0.00") -> Column:
    """Null if a part is missing, false across currencies, else whether the
    amounts differ by at most the tolerance."""
    return F.when(
        a.isNotNull() & a_currency.isNotNull() & b.isNotNull() & b_currency.isNotNull(),
        (a_currency == b_currency) & (F.abs(a - b) <= F.lit(tolerance).cast(MONEY)),
    )


def two_places(amount: Column) -> Column:
    """With thousands commas and two places, halves to even."""
    return F.format_number(F.bround(amount, 2), 2)
