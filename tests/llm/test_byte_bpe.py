"""Byte-level BPE in chunks against the library on whole texts."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strataweave.llm import byte_bpe
from strataweave.llm.common import prepare

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed: int) -> list[str | None]:
    rng = np.random.default_rng(seed)
    bits = ["word", "Über", " ", "  ", "\n", "\n\n ", "'ll", "'", "'re", "l", "12", "345", "!?", "…", "日本語", "🙂", " ", "a" * 40, "don't", "<|endoftext|>", "\t", "the quick"]
    out: list[str | None] = ["".join(rng.choice(bits, int(n))) for n in rng.integers(0, 400, 40)]
    return [*out, None, "", " ", "'", "x" * 5000, " " * 3000 + "x", "ab " * 2000, "é" * 900, out[0], out[0], "-=" * 700]


@pytest.mark.parametrize(("step", "overlap"), [(byte_bpe.STEP, byte_bpe.OVERLAP), (37, 21), (64, 8), (400, 60)])
def test_chunks_give_the_ids_of_whole_texts(spark, library, step, overlap):
    rows = [(i, t, "kept", "own", None) for i, t in enumerate(texts(1))]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, ids string, `row` string, `a.b` string").repartition(3)
    found = byte_bpe.encode_column(docs, PATH, PATTERN, step=step, overlap=overlap)
    assert found.columns == ["doc_id", "text", "ids", "row", "a.b", "ids_", "n_ids"]
    got = byte_bpe.decode_column(found, PATH, PATTERN, ids="ids_").collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode_ordinary(r["text"] or "")
        assert (r["ids_"], r["n_ids"], r["ids"], r["row"]) == (want, len(want), "kept", "own")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_neighbours_that_meet_nowhere_are_seen(spark):
    rows = [(1, "x" * 500), (2, "ab " * 200), (3, " " * 300)]
    long = prepare(spark).createDataFrame(rows, "row long, text string")
    marked = byte_bpe.pretokenised(byte_bpe.chunks_of(long, "text", 64, 16), PATTERN, 64, 16)
    whole = {r["row"]: r["whole"] for r in byte_bpe.seams(marked, 64).select("row", "whole").distinct().collect()}
    assert whole == {1: True, 2: False, 3: True}


def test_merges_of_both_kinds_agree(library):
    ranks = byte_bpe.Ranks.load(PATH)
    rng = np.random.default_rng(5)
    for n in (2, 3, 9, 30):
        raw = rng.choice(np.frombuffer(b"aeintrs _\xc3\xa9", np.uint8), (40, n))
        ids, count = ranks.merge_equal(raw)
        for row, i, c in zip(raw, ids, count, strict=True):
            assert i[:c].tolist() == ranks.merge_long(row.tobytes())


def test_digests_defined_for_every_row(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (2, ""), (3, "a b")]
    got = byte_bpe.digests(prepare(spark).createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN).collect()
    empty, two = (hashlib.sha256(b).hexdigest() for b in (b"", b"a b"))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in got) == sorted([(1, 0, empty), (2, 0, empty), (2, 0, empty), (0, 2, two), (3, 2, two)])
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_decoding_nulls_cut_characters_and_unknown_ids(spark, library):
    cut = library.encode_ordinary("🙂")[:1]
    docs = prepare(spark).createDataFrame([(1, None), (2, []), (3, cut), (3, cut)], "id int, ids array<int>")
    got = {r["id"]: r["decoded"] for r in byte_bpe.decode_column(docs, PATH, PATTERN).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == library.decode_bytes(cut)
    for bad in ([10**6], [None]):
        with pytest.raises(Exception, match="id"):
            byte_bpe.decode_column(spark.createDataFrame([(1, bad)], "id int, ids array<int>"), PATH, PATTERN).select(F.col("decoded")).collect()
