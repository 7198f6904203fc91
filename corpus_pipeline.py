"""A training corpus in five stages; each takes documents and gives documents, the last with their token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataweave.llm import bwt, kneser_ney, mixing, partenum, viterbi
from strataweave.llm.common import column, cut, numbered, prepare, scratch
from strataweave.llm.queries import table, tokenizer_path
from strataweave.session import discard, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go.

    Null, empty and long texts, ties, repeated rows, empty tables and clashing names are kneser_ney.accepted's: texts
    without words stay, and so do rows without doc_id that aren't toxic.
    """
    prepare(spark)
    model = kneser_ney.fit(docs, table(spark, sf_dir, "labels"))
    return kneser_ney.accepted(docs, model)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, and of rows with one doc_id, one stays: the component's smallest doc_id.

    Documents without words, null or empty, link with nothing and stay.  Of rows repeated under one doc_id the first by
    text stays; rows without doc_id all do.  Long texts are compared whole; other columns stay whatever their names; an
    empty table stays empty.  Only texts of ids that seem to be others' copies are shuffled, to be looked up exactly.
    """
    prepare(spark)
    plain, names = numbered(docs)
    doc_id, text = names["doc_id"], names["text"]
    found = cut(partenum.jaccard_join(docs).select("doc_id", "component_id"))
    stays = "doc_id is null or doc_id <=> component_id"
    one, gone = (found.where(x).select("doc_id").distinct() for x in (stays, f"not ({stays})"))
    asked = plain.withColumn("copy", partenum.possible(gone, F.col(doc_id)))
    looked_up = asked.where("copy").join(one, F.col(doc_id).eqNullSafe(F.col("doc_id")), "left_semi")
    kept = asked.where("not copy").union(looked_up).drop("copy")
    repeated = kept.groupBy(doc_id).count().where(f"count > 1 and {doc_id} is not null").select(doc_id)
    if repeated.isEmpty():
        return kept.select(*names.values()).toDF(*names)
    spread = F.when(F.col(doc_id).isNull(), F.xxhash64(text))
    first = kept.withColumn("n", F.row_number().over(W.partitionBy(doc_id, spread).orderBy(text)))
    return first.where(f"n = 1 or {doc_id} is null").select(*names.values()).toDF(*names)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; documents of which nothing is left go, documents that were empty stay.

    Null texts stay null.  Ties, repeated rows, long texts, clashing names and empty tables are bwt.kept_text's.
    """
    prepare(spark)
    full = "full"
    while full in {c.lower() for c in docs.columns}:
        full += "_"
    cut = bwt.kept_text(docs.withColumn(full, F.length("text") > 0))
    return cut.where(~(F.coalesce(F.col(full), F.lit(False)) & (F.length("text") == 0))).select(*[column(c) for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature 0.5, in a global random order.

    A null source is a source of its own, and one of only null or empty texts has no size and goes.  Rows repeat as
    drawn; long texts, ties and empty tables are mixing.mix_sources's.  Columns named like its results stay docs' own.
    """
    prepare(spark)
    plain, names = numbered(docs)
    mixed = mixing.mix_sources(plain, names["source"], names["doc_id"], text=names["text"])
    return mixed.select(*names.values()).toDF(*names)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the documents' columns.

    Null and empty texts have no ids; long texts, ties, repeated rows, empty tables and clashing names are
    viterbi.encode_column's.
    """
    prepare(spark)
    return viterbi.encode_column(docs, tokenizer_path("piece_bpe_32k.model"), keep=400_000, forget=True)  # its workers have other stages' memory too


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Model fitting, similarity joins and segmentation aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again.

    What a stage has written there goes when the next one's rows are written.
    """
    prepare(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            upto = written()
            path = scratch(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            discard(before, upto)  # the last stage's rows, and what this one wrote on its way
            before = upto
    return docs
