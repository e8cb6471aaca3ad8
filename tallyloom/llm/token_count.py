"""Token counts by counting each distinct pre-token once.

A piece never spans the start of a run of spaces or a line feed (checked on the
vocabulary), so a text's count is the sum of its pre-tokens' counts.  Texts
become per-document pre-token frequencies; the corpus vocabulary is counted
once per distinct pre-token; a join brings counts to frequencies and a sum per
document ends it.  Token ids are never materialised.

The vocabulary grows with the corpus, so only its most frequent part, of a
bounded size, is broadcast; the rare rest is joined by shuffling, where each
key is rare by construction and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.scratch import cut

SPACE = "▁"
#: A run of spaces with the word that follows, spaces before a line feed, or line feeds.
PRE_TOKEN = r" *[^ \n]+| +|\n+"


def load(model_path: str):
    """The processor without its dummy prefix; pre-tokens carry their own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def check_cuts(model_path: str) -> None:
    """Raise unless no piece spans a place where pre-tokens are cut."""
    sp = load(model_path)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or ("\n" in piece):
            raise ValueError(f"piece {i} of this model spans pre-tokens")


def pre_tokens(text: Column) -> Column:
    """The text's pre-tokens in order; an empty array for an empty text."""
    spaced = F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" ")))
    return F.when(text != "", F.regexp_extract_all(spaced, F.lit(PRE_TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _counter(model_path: str):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = load(model_path)
        for words in batches:
            yield words.map(lambda w: len(sp.encode(w)))

    return count


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_words: int = 200_000,
) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, one row per input row.

    ``model_path`` is a sentencepiece model at the same place on every machine.
    Counts equal ``len(SentencePieceProcessor.encode(text))``.  At most
    ``broadcast_words`` of the most frequent pre-tokens are broadcast.

    Null text counts as empty and has 0 bytes and 0 tokens; a null id stays
    null; repeated rows are counted each.  An empty table gives an empty
    result; other columns are ignored.  Very long texts are one row of the
    input and spread into their distinct pre-tokens.
    """
    check_cuts(model_path)
    # A document's key is made of its content, so that both passes over the
    # table agree on it however its rows are dealt out.
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("h"),
        F.posexplode_outer(pre_tokens(text)).alias("at", "word"),
    )
    key = ["doc_id", "n_bytes", "h"]

    pieces = F.pandas_udf(_counter(model_path), "long")
    vocabulary = words.where("word is not null").groupBy("word").agg(F.count("*").alias("total"))
    vocabulary = cut(vocabulary.select("word", "total", pieces("word").alias("pieces")), "token-vocabulary")

    # The largest power of two whose words fit the broadcast, from at most 63 counts.
    level = F.floor(F.log2("total")).cast("int").alias("level")
    sizes = {r["level"]: r["count"] for r in vocabulary.groupBy(level).count().collect()}
    floor, taken = 63, 0
    while floor and taken + sizes.get(floor - 1, 0) <= broadcast_words:
        floor -= 1
        taken += sizes.get(floor, 0)
    frequent = F.broadcast(vocabulary.where(F.col("total") >= 2**floor).select("word", "pieces"))
    rare = vocabulary.where(F.col("total") < 2**floor).select("word", F.col("pieces").alias("rare_pieces"))

    # Frequencies of known words collapse to one sum a document before the shuffle.
    looked_up = words.join(frequent, "word", "left")
    known = looked_up.groupBy(*key).agg(
        F.sum(F.coalesce("pieces", F.lit(0))).alias("t"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("copies")
    )
    unknown = (
        looked_up.where("word is not null and pieces is null")
        .select(*key, "word")
        .join(rare, "word")
        .groupBy(*key)
        .agg(F.sum("rare_pieces").alias("t"), F.lit(0).cast("long").alias("copies"))
    )
    # Rows that repeat id and text share a key; each of them gets its row back.
    return (
        known.unionByName(unknown)
        .groupBy(*key)
        .agg(F.sum("t").alias("t"), F.sum("copies").alias("copies"))
        .select(
            "doc_id",
            "n_bytes",
            F.expr("t div copies").alias("n_tokens"),
            F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("copy"),
        )
        .drop("copy")
    )
