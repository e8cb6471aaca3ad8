"""Merchant names: normal form, similarity and matching signal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyloom.config import MICRO, Settings, micros
from tallyloom.functions.columns import half_up, let

# Legal forms that are dropped at the end of a name.
LEGAL_FORMS = ("SIA", "AS", "LTD", "LLC", "INC")


def normalize_merchant(name: Column) -> Column:
    """Upper case, without points, apostrophes and trailing legal forms; other
    marks but ``&`` become one space.  Null stays null."""
    text = F.regexp_replace(F.replace(F.upper(name), F.lit(" & "), F.lit(" AND ")), "[.'’]", "")
    text = F.trim(F.regexp_replace(text, r"(?U)[^\w&]+|_+|\s+", " "))
    text = F.regexp_replace(text, " +", " ")
    return F.trim(F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(LEGAL_FORMS)}))+$", ""))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(LongType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common_subsequence(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")


def sorted_tokens(normal: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normal, " ")), " ")


def similarity(left: Column, right: Column) -> Column:
    """Similarity of two normalised names in millionths: twice the longest
    common subsequence of the sorted words over both lengths."""
    a, b = sorted_tokens(left), sorted_tokens(right)
    ratio = half_up(2 * MICRO * common_subsequence(a, b), (F.length(a) + F.length(b)).cast("long"))
    return F.when(left.isNull() | right.isNull(), None).when((left == "") | (right == ""), F.lit(0).cast("long")).otherwise(ratio)


def _touches(token: Column, others: Column) -> Column:
    """Whether a token equals, begins or extends any of the others."""
    return F.exists(others, lambda o: o.startswith(token) | token.startswith(o))


def brand_matches(left: Column, right: Column, minimum: int) -> Column:
    """Whether the first distinctive word of either name, one of at least
    ``minimum`` letters, meets a distinctive word of the other."""
    long_words = lambda name: F.filter(F.split(name, " "), lambda t: F.length(t) >= minimum)
    return let(
        F.struct(long_words(left).alias("l"), long_words(right).alias("r")),
        lambda w: (F.size(w["l"]) > 0)
        & (F.size(w["r"]) > 0)
        & (_touches(F.get(w["l"], F.lit(0)), w["r"]) | _touches(F.get(w["r"], F.lit(0)), w["l"])),
    )


def merchant_signal(left: Column, right: Column, settings: Settings) -> Column:
    """Signal in millionths of two normalised names; null if one is missing.

    A brand word lifts it to the token score, and a name shorter than the
    minimum length is capped; the cap wins."""
    bands = settings.merchants
    score = similarity(left, right)
    lifted = F.when(brand_matches(left, right, bands.minimum_length), F.greatest(score, F.lit(micros(bands.token_score)))).otherwise(score)
    short = F.least(F.length(left), F.length(right)) < bands.minimum_length
    capped = F.when(short, F.least(lifted, F.lit(micros(bands.short_cap)))).otherwise(lifted)
    return F.when((left != "") & (right != ""), capped.cast("long"))


def plain_signal(left: str, right: str, settings: Settings) -> int:
    """``merchant_signal`` of two names that are not empty, for tasks that walk
    ranked names and compare few of them."""
    bands = settings.merchants
    a, b = (" ".join(sorted(name.split(" "))) for name in (left, right))
    n = len(a) + len(b)
    score = (4 * MICRO * _common_subsequence(a, b) + n) // (2 * n)
    l, r = ([t for t in name.split(" ") if len(t) >= bands.minimum_length] for name in (left, right))  # noqa: E741
    touches = lambda token, others: any(o.startswith(token) or token.startswith(o) for o in others)
    if l and r and (touches(l[0], r) or touches(r[0], l)):
        score = max(score, micros(bands.token_score))
    if min(len(left), len(right)) < bands.minimum_length:
        score = min(score, micros(bands.short_cap))
    return score
