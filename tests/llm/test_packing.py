import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm.packing import Cache, Encoder, best_fit_decreasing, lower_bound, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bins_are_sound_and_bounded(sizes):
    lengths = np.array(sizes)
    bins, offsets, n = best_fit_decreasing(lengths, 20)
    assert lower_bound(lengths, 20) <= n
    for k in range(n):
        inside = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == k)
        at = 0
        for offset, size in inside:
            assert offset == at
            at += size
        assert 0 < at <= 20


def test_pieces_and_sequences(docs_of):
    texts = [None, "", "Hello, World! it's 'stop' x''s", "<|endoftext|> a", "é É ß İ Σας 漢字 \x1c y\x85z\xa0q ½", "word " * 9000] + [f"text {i} " * (i % 90) for i in range(300)]
    found = pack_documents(docs_of(texts), PATH, group_rows=40).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    total = 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        own = found[found.doc_id == i].sort_values("piece")
        assert list(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, group in found.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.length.cumsum() - group.length == group.offset).all() and group.length.sum() <= 4096
    assert found.sequence_id.nunique() <= -(-total // 4096) + 1


@pytest.mark.parametrize(("name", "by_words"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_tokenizers(name, by_words):
    encoder, rng = Encoder(public_tokenizers.path(name), held=50), random.Random(1)
    assert encoder.by_words == by_words
    signs = "abcXYZ'  \t\n<|>/wstremdl''éß1²½ªİıλ漢\x1c\x85\xa0_-!"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(2000)] + ["", "a" * 3000, "the <|endoftext|>"]
    for lot in (texts[:900], texts[900:], []):
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in lot]
        assert [ids.tolist() for ids in encoder.encode(pa.array(lot, pa.string()))] == want


def test_cache_is_bounded():
    cache = Cache(3)
    for k in "abcdefgha":
        cache.turn()
        cache.new.update(dict.fromkeys(cache.missing([k]), b""))
        assert k in cache.new and len(cache.new) <= 4 and len(cache.old) <= 4


def test_empty_table_and_repeats(docs_of):
    assert pack_documents(docs_of(["a"]).limit(0), PATH).count() == 0
    assert pack_documents(docs_of(["a"]).union(docs_of(["a"])), PATH).count() == 2
