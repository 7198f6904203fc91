"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words, one of toxic and one of ordinary documents.  Each predicts a symbol (a byte, or a word's end)
from up to five before it in the word: at the longest context by its class's own counts, discounted as Kneser-Ney does
and drawn by STRENGTH to what both classes share, which are their counts together and, below, an interpolated Kneser-Ney
distribution of continuation counts from the words of all documents.  So an expression that a class has hardly seen is
about as likely in both.

A toxic document is mostly ordinary words.  Its likelihood spells each word by the ordinary model, or as a toxic
expression at a prior chance, whichever is the likelier way; an ordinary document's spells all by the ordinary model.
A document's evidence is the difference of the two log-likelihoods divided by its number of words.  The prior chance and
the cut are set on a calibrating fold.

Where neither class has seen a symbol after its context, both give it what they share times their own weight of backing
off, so what they share cancels and the difference is that of the weights' logarithms; after a context that neither has
seen both weights are 1.  So scoring needs the grams and contexts of the labelled sample only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, CHUNK_BYTES, LOWER, cut, flat_bytes, numbered, text_chunks, words

CONTEXT = 5
BEGIN, END = 2, 3
SHARED_DISCOUNT = 0.75
#: The classifier is fitted on at most so many labelled rows of each class and fold, those of the smallest hashes.
MAX_LABELLED = 5000
THRESHOLD = 0.3


#: Each gram that a class has seen gives up this much of its count to what both classes share.
DISCOUNT = 0.75
#: Beside that, what both share weighs as much as so many symbols of the class's own after a context.
STRENGTH = 30.0
#: Prior chances of a toxic expression that are tried on the calibrating fold, as their negative logarithms.
MARGINS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0)


@dataclass(frozen=True)
class Model:
    grams: np.ndarray  # sorted codes
    evidence: np.ndarray  # log p(toxic) - log p(ordinary) of the gram's last symbol
    contexts: np.ndarray  # sorted codes of the grams without their last symbols
    backing: np.ndarray  # the same difference for any symbol that neither class has seen after the context
    margin: float = 3.0
    slope: float = 1.0
    middle: float = 0.0


def symbols(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A code for each symbol of each word: it and up to five before it, behind a marker bit.  One more than bytes for a word."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths + 2)
    s = np.empty(int(ends[-1]), dtype=np.int64)
    place = np.arange(len(s)) - np.repeat(ends - lengths - 2, lengths + 2)
    inner = (place > 0) & (place <= np.repeat(lengths, lengths + 2))
    s[inner] = flat
    s[ends - 1], s[ends - lengths - 2] = END, BEGIN
    code = s.copy()
    for k in range(1, CONTEXT + 1):
        back = np.zeros_like(s)
        back[k:] = s[:-k]
        code |= np.where(place >= k, back << (8 * k), 0)
    code |= np.int64(1) << (8 * np.minimum(place + 1, CONTEXT + 1))
    return code[place > 0]


def length(code: np.ndarray) -> np.ndarray:
    """How many symbols a code has."""
    return sum((code >= np.int64(1) << (8 * k)).astype(np.int64) for k in range(1, CONTEXT + 2))


def shorter(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The code's last n symbols."""
    top = np.int64(1) << (8 * n)
    return (code & (top - 1)) | top


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' words: the distinct ones' bytes and lengths, each word's place among them, and each row's first word."""
    h, firsts = words(data, offsets)
    _, one, place = np.unique(h, return_index=True, return_inverse=True)
    solid = ~BLANK[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # words never cross rows
    begin[edge], last[edge - 1] = solid[edge], solid[edge - 1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(last) + 1
    starts, lengths = starts[one], (stops - starts)[one]
    index = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    return LOWER[data[index]], lengths, place, firsts


def evidence(model: Model, code: np.ndarray) -> np.ndarray:
    if not len(model.grams):
        return np.zeros(len(code))
    at = np.minimum(np.searchsorted(model.grams, code), len(model.grams) - 1)
    out = np.where(model.grams[at] == code, model.evidence[at], 0.0)
    unseen = np.flatnonzero(model.grams[at] != code)
    before = code[unseen] >> 8
    at = np.minimum(np.searchsorted(model.contexts, before), len(model.contexts) - 1)
    out[unseen] = np.where(model.contexts[at] == before, model.backing[at], 0.0)
    return out


def normalised(model: Model, data: np.ndarray, offsets: np.ndarray, margins: tuple[float, ...] | None = None) -> np.ndarray:
    """The difference of a row's log-likelihoods a word, for each margin; 0 without words."""
    margins = margins or (model.margin,)
    flat, lengths, place, firsts = distinct_words(data, offsets)
    counts = np.diff(firsts)
    out = np.zeros((len(counts), len(margins)))
    if not len(place):
        return out
    by_word = np.add.reduceat(evidence(model, symbols(flat, lengths)), np.cumsum(lengths + 1) - lengths - 1)[place]
    row = np.repeat(np.arange(len(counts)), counts)
    for i, margin in enumerate(margins):  # log max(p ordinary, chance * p toxic) - log p ordinary
        out[:, i] = np.bincount(row, weights=np.maximum(by_word - margin, 0), minlength=len(counts)) / np.maximum(counts, 1)
    return out


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    z = model.slope * (x - model.middle) + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, word, n) of each chunk of labelled rows."""
    for batch in text_chunks(batches):
        toxic = np.asarray(batch.column("toxic"))
        for label in (0, 1):
            rows = batch.filter(pa.array(toxic == label))
            data, offsets = flat_bytes(rows.column("text"))
            if len(data):
                flat, lengths, place, _ = distinct_words(data, offsets)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(flat)])
                n = np.bincount(place, minlength=len(lengths))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), label, np.int32)), raw.cast(pa.binary()), pa.array(n)], names=["toxic", "word", "n"])


def corpus_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of two to six symbols in a task's words."""
    kept = np.zeros(0, np.int64)
    for batch in text_chunks(batches):
        data, offsets = flat_bytes(batch.column("text"))
        if not len(data):
            continue
        flat, lengths, _, _ = distinct_words(data, offsets)
        code = np.unique(symbols(flat, lengths))
        n = length(code)
        kept = np.unique(np.concatenate([kept, *[shorter(code[n >= k], np.full(int((n >= k).sum()), k)) for k in range(2, CONTEXT + 2)]]))
        if len(kept) > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(kept)], names=["gram"])
            kept = np.zeros(0, np.int64)
    if len(kept):
        yield pa.RecordBatch.from_arrays([pa.array(kept)], names=["gram"])


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, toxic, fold): at most limit rows of each class in the fitting folds (0, 1) and the calibrating one (3)."""
    from pyspark.sql import Window as W

    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int")
    known = known.withColumn("fold", fold).where("fold <> 2").withColumn("fold", F.when(F.col("fold") == 3, 3).otherwise(0))
    draw = F.xxhash64("doc_id", F.lit(5))
    salted = known.withColumn("_h", draw).withColumn("_s", F.pmod("_h", F.lit(64)))
    first = salted.withColumn("_n", F.row_number().over(W.partitionBy("toxic", "fold", "_s").orderBy("_h"))).where(F.col("_n") <= limit)
    return first.withColumn("_n", F.row_number().over(W.partitionBy("toxic", "fold").orderBy("_h"))).where(F.col("_n") <= limit).select("doc_id", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """The models from the labelled sample and all documents, and the score's scale from the calibrating fold.

    Labels other than 0 and 1 and rows without doc_id don't count; of several labels of one document the largest does,
    and documents repeated under one doc_id count as often as they come.  Null texts are empty.  Without labels of both
    classes, or with an empty table, the model gives every document the same low score.  Long texts are read whole, a
    chunk each.  Ties between cuts go to the smaller prior chance.  Other columns are never looked at.
    """
    spark = docs.sparkSession
    sample = spark.createDataFrame(labelled_sample(labels, label, max_labelled).toPandas().astype({"doc_id": "int64", "toxic": "int32", "fold": "int32"}), "doc_id long, toxic int, fold int")  # at most 4 * max_labelled rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counted = texts.where("fold = 0").select("toxic", "text").mapInArrow(word_counts, "toxic int, word binary, n long").groupBy("toxic", "word").agg(F.sum("n").alias("n")).toArrow()
    toxic = np.asarray(counted["toxic"])
    by_class = [_counts(counted.filter(pa.array(toxic == c))) for c in (0, 1)]
    if not len(by_class[0][0]) or not len(by_class[1][0]):
        empty = np.zeros(0, np.int64)
        return Model(empty, empty.astype(float), empty, empty.astype(float), middle=10.0)
    grams = np.union1d(by_class[0][0], by_class[1][0])
    shared = _shared(docs, grams)
    model = _combine(grams, by_class, shared)
    seen = _calibrating(texts.where("fold = 3"), model)
    return _scaled(model, seen)


def _counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0)
    data, offsets = flat_bytes(table["word"].combine_chunks())
    lengths, n = np.diff(offsets), np.asarray(table["n"])
    code, place = np.unique(symbols(data, lengths), return_inverse=True)
    return code, np.bincount(place, weights=np.repeat(n, lengths + 1))


def _shared(docs: DataFrame, grams: np.ndarray) -> np.ndarray:
    """The shared probability of each gram's last symbol after all but the first of its others."""
    spark = docs.sparkSession
    all_grams = docs.select("text").mapInArrow(corpus_grams, "gram long").distinct()
    n_of = sum((F.col("gram") >= F.lit(1 << 8 * k)).cast("int") for k in range(1, CONTEXT + 2))
    top = F.expr("shiftleft(cast(1 as bigint), 8 * (_n - 1))")
    tails = all_grams.withColumn("_n", n_of).select((F.col("gram").bitwiseAND(top - 1)).bitwiseOR(top).alias("tail")).groupBy("tail").agg(F.count("*").alias("c"))
    lengths = length(grams)
    needed = np.unique(np.concatenate([shorter(grams[lengths > k], np.full(int((lengths > k).sum()), k)) for k in range(1, CONTEXT + 1)]))
    contexts = np.unique(needed >> 8)  # the sample bounds them
    import pandas as pd

    wanted = spark.createDataFrame(pd.DataFrame({"context": contexts}), "context long")
    rows = cut(tails.withColumn("context", F.shiftright("tail", 8)).join(F.broadcast(wanted), "context"))
    sums = rows.groupBy("context").agg(F.sum("c").alias("s"), F.count("*").alias("t")).toArrow()
    own = rows.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"tail": needed}), "tail long")), "tail").select("tail", "c").toArrow()
    s_code, s, t = (np.asarray(sums[x]) for x in ("context", "s", "t"))
    o_code, o = np.asarray(own["tail"]), np.asarray(own["c"])
    s_order, o_order = np.argsort(s_code), np.argsort(o_code)
    s_code, s, t, o_code, o = s_code[s_order], s[s_order], t[s_order], o_code[o_order], o[o_order]

    def find(codes: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(x))
        at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
        return np.where(codes[at] == x, values[at], 0)

    p = np.full(len(grams), 1 / 257)
    for k in range(1, CONTEXT + 1):
        rows_k = np.flatnonzero(lengths > k)
        g = shorter(grams[rows_k], np.full(len(rows_k), k))
        total = find(s_code, s, g >> 8)
        share = np.maximum(find(o_code, o, g) - SHARED_DISCOUNT, 0) / np.maximum(total, 1)
        back = np.where(total > 0, SHARED_DISCOUNT * find(s_code, t, g >> 8) / np.maximum(total, 1), 1.0)
        p[rows_k] = share + back * p[rows_k]
    return p


def _combine(grams: np.ndarray, by_class: list[tuple[np.ndarray, np.ndarray]], shared: np.ndarray) -> Model:
    """Each class's discounted counts; what that and STRENGTH free goes to both classes' counts together, and theirs to the corpus."""
    contexts, first, place = np.unique(grams >> 8, return_index=True, return_inverse=True)
    count = np.zeros((2, len(grams)))
    for c, (code, n) in enumerate(by_class):
        count[c, np.searchsorted(grams, code)] = n
    both = count.sum(axis=0)
    total, kinds = np.bincount(place, weights=both)[place], np.bincount(place, weights=both > 0)[place]
    pooled = (np.maximum(both - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * kinds * shared) / total
    logs, backs = [], []
    for own in count:
        less = np.minimum(own, DISCOUNT)
        n = np.bincount(place, weights=own)[place] + STRENGTH
        back = (STRENGTH + np.bincount(place, weights=less)[place]) / n
        logs.append(np.log((own - less) / n + back * pooled))
        backs.append(np.log(back[first]))
    return Model(grams, logs[1] - logs[0], contexts, backs[1] - backs[0])


def _calibrating(texts: DataFrame, model: Model) -> np.ndarray:
    """A row for each text of the calibrating fold: its label, and its evidence for each margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            x = normalised(model, *flat_bytes(batch.column("text")), MARGINS)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(v) for v in np.ascontiguousarray(x.T)]], names=["toxic", *names])

    names = [f"x{i}" for i in range(len(MARGINS))]
    rows = texts.select("toxic", "text").mapInArrow(run, "toxic int, " + ", ".join(f"{x} double" for x in names)).toArrow()
    return np.stack([np.asarray(rows[c], dtype=float) for c in ("toxic", *names)], axis=1)


def _cut(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The best F1 of any cut, and that cut: a third of the way from the last value above it to the next."""
    order = np.argsort(-x, kind="stable")
    xs, hits = x[order], np.cumsum(y[order])
    f1 = np.where(np.append(xs[1:] < xs[:-1], True), 2 * hits / (np.arange(1, len(xs) + 1) + y.sum()), -1)
    best = int(np.argmax(f1))
    after = xs[best + 1] if best + 1 < len(xs) else 0.0
    return float(f1[best]), float(max(xs[best] - (xs[best] - after) / 3, 1e-6))


def _scaled(model: Model, seen: np.ndarray) -> Model:
    """The margin and the cut with the best F1 on the calibrating fold, and a logistic fit's slope."""
    y = seen[:, 0]
    if not y.any() or y.all():
        x = seen[:, 2]
        spread = float(np.std(x)) or 1.0
        return replace(model, slope=4 / spread, middle=float(x.mean() + 3 * spread) if len(x) else 1.0)
    cuts = [_cut(seen[:, i + 1], y) for i in range(len(MARGINS))]
    i = max(range(len(MARGINS)), key=lambda j: (round(cuts[j][0], 6), -j))
    x, middle = seen[:, i + 1], cuts[i][1]
    spread = float(np.std(x)) or 1.0
    z, a, b = (x - middle) / spread, 1.0, 0.0
    for _ in range(60):  # Newton's steps with a small penalty, so that separable classes have a finite slope
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 0.1 * a, (p - y).sum() + 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return replace(model, margin=MARGINS[i], slope=max(float(a), 0.1) / spread, middle=middle)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns in carry, for every row.

    Rows without words, null and empty texts among them, have evidence 0.  A null doc_id is held out of nothing.
    Repeated rows score alike, an empty table gives none, and a long text is scored whole.  Other columns of docs play
    no part whatever their names; one in carry that is named like a result stands beside it.
    """
    plain, names = numbered(docs)
    kept = [names[c] for c in carry if c != "doc_id"]
    scored = _scored(plain, names, model, threshold, kept)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = scored.select("doc_id", held.alias("held_out"), "score", "predicted", *kept)
    return out.toDF("doc_id", "held_out", "score", "predicted", *[c for c in carry if c != "doc_id"])


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows with a score below the threshold, with docs' columns and types."""
    plain, names = numbered(docs)
    return _scored(plain, names, model, threshold, list(names.values())).where("predicted = 0").select(*names.values()).toDF(*names)


def _scored(plain: DataFrame, names: dict[str, str], model: Model, threshold: float, kept: list[str]) -> DataFrame:
    """doc_id, the numbered columns in kept, score and predicted."""
    shared = plain.sparkSession.sparkContext.broadcast(model)  # the labelled sample bounds it
    source = plain.select(F.col(names["doc_id"]).cast("long").alias("doc_id"), F.col(names["text"]).cast("string").alias("body"), *[c for c in kept if c != names["text"]])
    carried = ["body" if c == names["text"] else c for c in kept]
    types = [T.StructField("doc_id", T.LongType()), *[T.StructField(c, source.schema[b].dataType) for c, b in zip(kept, carried, strict=True)]]
    schema = T.StructType([*types, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "body", limit=CHUNK_BYTES):
            p = probability(shared.value, normalised(shared.value, *flat_bytes(batch.column("body")))[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(b) for b in carried], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", *kept, "score", "predicted"])

    return source.mapInArrow(run, schema)
