"""All ten operators and five stages on rows whose other columns have the names that operators use inside or return."""

import random

import pytest
from pyspark.sql import functions as F

from strataweave.llm import blocks, bwt, hash_tree, kneser_ney, mixing, nndescent, ogg, partenum, range_coder, viterbi
from strataweave.llm.common import column

EXTRA = ["at", "_h", "_id", "_n", "_full", "full", "score", "predicted", "held_out", "my col", "a.b", "h", "id", "n", "c0", "shard", "slot", "rate", "copy", "ids", "body", "component_id", "size"]


def plain(n=60):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(80)}" for _ in range(r.randrange(3, 40))), "en", "ab"[i % 2], 5) for i in range(n)]
    return [*rows, (n, rows[3][1], "en", "a", 5), (n + 1, None, "en", None, None), (n + 2, "", "en", "a", 0), (None, "no id", "en", "b", 5), (5, rows[5][1], "en", "b", 5), (n + 3, "long " * 30_000, "en", "a", 5)]


@pytest.fixture(scope="module")
def clashing(llm):
    df = llm.createDataFrame(plain(), "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        df = df.withColumn(c, F.concat(F.lit(c + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df.cache()


def untouched(out, extra):
    """Every row's extra columns still hold its doc_id."""
    for c in extra:
        bad = out.where(~column(c).eqNullSafe(F.concat(F.lit(c + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
        assert bad.isEmpty(), c


def test_operators(llm, clashing):
    P = pytest.importorskip("public_tokenizers")
    n = clashing.count()
    alone = clashing.select("doc_id", "text", "source", "lang", "n_chars")

    def same(a, b):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    same(ogg.media_column(clashing), ogg.media_column(alone))
    same(partenum.jaccard_join(clashing), partenum.jaccard_join(alone))
    mixed = mixing.mix_sources(clashing)
    untouched(mixed, [c for c in EXTRA if c not in ("rate", "copy")])
    same(mixed.select("doc_id", "text", "rate", "copy", "shuffle_key"), mixing.mix_sources(alone).select("doc_id", "text", "rate", "copy", "shuffle_key"))
    encoded = viterbi.encode_column(clashing, P.path("piece_bpe_32k.model"))
    assert encoded.count() == n
    untouched(encoded, [c for c in EXTRA if c != "ids"])
    untouched(viterbi.decode_column(encoded.withColumnRenamed("text", "was"), P.path("piece_bpe_32k.model")), [c for c in EXTRA if c != "ids"])
    same(bwt.removed_bytes(clashing), bwt.removed_bytes(alone))
    cut = bwt.kept_text(clashing)
    assert cut.columns == clashing.columns and cut.count() == n
    untouched(cut, EXTRA)
    labels = llm.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").withColumn("score", F.lit("x"))
    model = kneser_ney.fit(clashing, labels)
    scored = kneser_ney.score(clashing, model, carry=tuple(c for c in EXTRA if c not in ("score", "predicted", "held_out")))
    assert scored.count() == n
    untouched(scored, [c for c in EXTRA if c not in ("score", "predicted", "held_out")])
    beside = kneser_ney.score(clashing, model, carry=("score", "a.b"))
    assert beside.columns == ["doc_id", "held_out", "score", "predicted", "score", "a.b"] and beside.count() == n
    same(range_coder.encode_table(clashing, P.path("byte_bpe_50k.json")), range_coder.encode_table(alone, P.path("byte_bpe_50k.json")))
    placed = hash_tree.shard_rows(clashing, 4)
    assert placed.count() == n
    untouched(placed, [c for c in EXTRA if c not in hash_tree.RESULTS])
    vectors = clashing.where("doc_id < 60").selectExpr("doc_id vec_id", "array(cast(doc_id as float), 1f) embedding", "score", "id", "`a.b`")
    assert nndescent.nearest(vectors).count() == 3 * 20
    pages = clashing.selectExpr("doc_id page_id", "text html", "'u' url", "*")
    same(blocks.extract(pages), blocks.extract(pages.select("page_id", "url", "html")))


def test_stages(llm, clashing, tmp_path):
    import corpus_pipeline

    ids = [r["doc_id"] for r in clashing.select("doc_id").distinct().collect() if r["doc_id"] is not None]
    llm.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(llm, clashing, str(tmp_path))
        assert out.columns[: len(clashing.columns)] == clashing.columns or i == 4, name
        assert not out.isEmpty() and {f.name: f.dataType for f in out.schema}.items() >= {f.name: f.dataType for f in clashing.schema if f.name != "ids"}.items(), name
        untouched(out, [c for c in EXTRA if i < 4 or c != "ids"])
        assert stage(llm, clashing.limit(0), str(tmp_path)).isEmpty(), name
