"""URL rules by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that a rule could name: every suffix
of its host at a label boundary, with the path prefixes whose lengths occur in
the rules.  Expressions meet rules in an equi-join on the first bytes of a
SHA-256, the full digest confirms, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, broadcast_if_small

RULE_SCHEMA = "action string, host string, path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to / ? # or the end, A-Z lower-cased, and
    the path from there up to ? # or the end.  Both are empty for a null URL or
    one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_bytes: int = 4,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """Return page_id, host, path, rule, verdict, one row per input row.

    ``rules`` has action (allow or block), host and path; a null path is empty.
    A rule fits its host and all subdomains when the URL's path starts with the
    rule's.  Of the rules that fit the longest host-and-path wins, then block
    before allow, then the smaller text.  ``rule`` is that text or null, and
    ``verdict`` its action or ``default``.

    Null URLs and URLs without ``://`` have empty host and path, which no rule
    fits.  Repeated rows are judged each on its own.  An empty table of pages or
    rules is fine; other columns are ignored.
    """
    spark = pages.sparkSession
    listed = rules.select(
        "action",
        F.lower("host").alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
    ).where("rule_host is not null and rule_host <> ''")
    listed = listed.withColumn("rule", F.concat("rule_host", "rule_path"))
    digest = lambda h, p: F.unhex(F.sha2(F.concat(h, F.lit("\x00"), p), 256))
    listed = listed.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path")))
    listed = listed.withColumn("short", F.substring("rule_digest", 1, prefix_bytes))

    # Shapes that rules have: so many labels in the host, so many characters in the path.
    shape = listed.agg(
        F.collect_set(F.length("rule_path")).alias("p"),
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("l"),
    ).first()
    path_lengths, labels = sorted(shape["p"]), sorted(shape["l"])

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    urls = urls.withColumn("row", F.monotonically_increasing_id())
    suffixes = [F.substring_index("host", ".", -n) for n in labels]
    counted = F.size(F.split("host", r"\."))
    pairs = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.lit(n) <= counted) & (F.col("host") != "") & (F.length("path") >= k),
                    F.struct(s.alias("h"), F.substring("path", 1, k).alias("p")),
                )
                for n, s in zip(labels, suffixes, strict=True)
                for k in path_lengths
            ]
        )
    )
    spelled = urls.withColumn("e", F.explode_outer(pairs))
    spelled = spelled.withColumn("digest", F.when(F.col("e").isNotNull(), digest(F.col("e.h"), F.col("e.p"))))
    spelled = spelled.withColumn("short", F.substring("digest", 1, prefix_bytes))
    met = spelled.join(broadcast_if_small(listed, broadcast_rows), "short", "left")
    # An expression that only shares the short hash, or none, keeps its URL with a null rule.
    confirmed = F.col("digest") == F.col("rule_digest")
    order = F.when(
        confirmed,
        F.struct(
            F.length("rule").alias("n"),
            (F.col("action") == "block").cast("int").alias("b"),
            F.length("rule_host").alias("h"),
            F.col("rule").alias("rule"),
            F.col("action").alias("action"),
        ),
    )
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(order).alias("best"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
