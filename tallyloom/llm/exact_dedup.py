"""Exact duplicates by progressive refinement, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z.  Three levels narrow
the rows whose whole content must be read:

1. byte length: rows whose length nobody shares are single;
2. length and a hash of the first characters;
3. SHA-256 of the whole normalised text, for rows that two levels left.

Every level is an aggregation with map-side combining, so a group that holds a
third of all rows reaches each reducer as one row per map task.  The last step
joins one row per group back to the members; only the member side can be
skewed, and a sort-merge join lets adaptive execution split that side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, broadcast_if_small
from tallyloom.scratch import cut


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_chars: int = 96,
    digest_all: bool = False,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id of the group; ``kept`` marks that row.
    ``text_sha256`` is null for rows that levels 1 and 2 proved single, unless
    ``digest_all`` asks for it everywhere (the digest is then computed in the
    scan of level 3).  ``broadcast_rows`` bounds the lists of surviving lengths
    and heads that are broadcast; longer lists are joined by shuffling lengths,
    heads and texts, with the same result.

    Null text counts as empty text, and all empty texts are one group.  A null
    id loses against any id; a group of null ids has keep_id null and all are
    kept.  Rows that repeat an id with equal text share one decision.  Texts of
    any length are hashed whole.  An empty table gives an empty result; other
    columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    # Lower-casing A-Z changes no length, and of a long text only the head is lower-cased here.
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        raw.alias("text"),
        F.octet_length(raw).alias("len"),
        F.xxhash64(ascii_lower(F.substring(raw, 1, head_chars))).alias("head"),
    )

    lengths = rows.groupBy("len").agg(F.count("*").alias("c")).where("c > 1").select("len")
    lengths = cut(lengths, "exact-lengths")

    heads = (
        rows.select("len", "head")
        .join(broadcast_if_small(lengths, broadcast_rows), "len", "left_semi")
        .groupBy("len", "head")
        .agg(F.count("*").alias("c"))
        .where("c > 1")
        .select("len", "head", F.lit(True).alias("shared"))
    )
    heads = cut(heads, "exact-heads")

    digest = F.unhex(F.sha2(ascii_lower(F.col("text")), 256))
    level3 = rows.join(broadcast_if_small(heads, broadcast_rows), ["len", "head"], "left").select(
        "doc_id",
        F.coalesce("shared", F.lit(False)).alias("shared"),
        (digest if digest_all else F.when(F.col("shared"), digest)).alias("digest"),
    )
    level3 = cut(level3, "exact-digests")

    alone = level3.where("not shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    members = level3.where("shared").select("doc_id", "digest")
    groups = members.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    # Written first: adaptive execution splits a hot group only where both sides are plain exchanges.
    groups = cut(groups, "exact-groups")
    grouped = members.join(groups.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", "digest")
    return alone.unionByName(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
