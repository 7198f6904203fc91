"""Mixing sources to target weights by Poisson replication.

A source's rows are wanted rate = weight * budget / size times on average (its mean target repetition rate).  A row's
hash, seeded, gives u in [0, 1); the smallest k whose Poisson distribution function exceeds u is its number of copies.
So every row is decided alone, a third of all rows in one source needs no shuffle to be decided, and the result does
not depend on partitions or retries.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, numbered

#: Up to so many sources, rates are literals in the plan; beyond, they are joined.
MAX_LITERAL_SOURCES = 1000


def unit(*key: Column) -> Column:
    """Uniform in [0, 1), 52 bits of an MD5 of the key's parts; nulls count as the empty text, which no number is."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def shuffle_key(*key: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def rates(df: DataFrame, source: str = "source", size: Column | None = None, weights: dict[str | None, float] | None = None, temperature: float = 0.5, budget: float | None = None) -> DataFrame:
    """(source, rate): weights as given (sources not named get 0), else size ** temperature; budget as given, else the whole size.

    A source without any size (only empty rows) has rate 0.  A null source is a source of its own.
    """
    size = F.length(F.coalesce("text", F.lit(""))) if size is None else size
    sizes = df.groupBy(F.col(source).alias("_source")).agg(F.sum(size).cast("double").alias("_size"))
    if weights is None:
        weight = F.when(F.col("_size") > 0, F.pow("_size", F.lit(float(temperature)))).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    shares = sizes.withColumn("_weight", weight)
    whole = shares.agg(F.sum("_weight").alias("_all"), F.sum("_size").alias("_total"))
    goal = F.col("_total") if budget is None else F.lit(float(budget))
    rate = F.when((F.col("_size") > 0) & (F.col("_all") > 0), F.col("_weight") / F.col("_all") * goal / F.col("_size")).otherwise(0.0)
    return shares.join(F.broadcast(whole)).select("_source", rate.alias("_rate"))  # whole is one row


def distribution(rate: DataFrame) -> DataFrame:
    """(_source, _rate, _cdf): the Poisson distribution function at 0, 1, ... until what is left is below any hash."""
    last = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 40).cast("int")
    k = rate.select("_source", "_rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    up = W.partitionBy("_source").orderBy("k")
    pmf = F.when(F.col("_rate") > 0, F.exp(F.col("k") * F.log("_rate") - F.col("_rate") - F.col("_logs"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    k = k.withColumn("_logs", F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(up)).withColumn("_p", pmf).withColumn("_c", F.sum("_p").over(up))
    return k.groupBy("_source", "_rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_c"))), lambda x: x["_c"]).alias("_cdf"))


def mix_sources(df: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 11, weights: dict[str | None, float] | None = None, temperature: float = 0.5, budget: float | None = None, size: Column | None = None, text: str = "text") -> DataFrame:
    """df's rows as often as drawn, in a global random order, with copy (from 1), rate and shuffle_key.

    Rows that share key and source draw alike; rows without a key draw by their text.  Copies that draw 0 are gone,
    which is what mixing is.  A null text has no size, a long one is never moved but with its row; an empty table stays
    empty.  Columns of df named like results are replaced, others are carried whatever their names.
    """
    spark = df.sparkSession
    size = F.length(F.coalesce(column(text), F.lit(""))) if size is None else size
    # one row for each source; collect_list holds a source's distribution, which its rate bounds
    table = distribution(rates(df, source, size, weights, temperature, budget))
    known = table.limit(MAX_LITERAL_SOURCES + 1).collect()
    carried = [c for c in df.columns if c not in ("copy", "rate", "shuffle_key")]
    plain, names = numbered(df.select(*[column(c) for c in carried]))
    of, drawn_by = F.col(names[source]), F.coalesce(F.col(names[key]).cast("string"), F.md5(F.coalesce(F.col(names[text]), F.lit("")).cast("binary")))
    if len(known) <= MAX_LITERAL_SOURCES:
        rate, cdf = F.lit(0.0), F.array(F.lit(1.0))
        for row in known:
            mine = of.eqNullSafe(F.lit(row["_source"]))
            rate = F.when(mine, F.lit(row["_rate"])).otherwise(rate)
            # the tail at which no 52-bit hash can arrive adds nothing
            cdf = F.when(mine, F.array(*[F.lit(x) for x in _needed(row["_cdf"])])).otherwise(cdf)
        drawn = plain.withColumn("rate", rate).withColumn("_cdf", cdf)
    else:
        drawn = plain.join(table.withColumnRenamed("_rate", "rate"), of.eqNullSafe(F.col("_source"))).drop("_source")
    u = unit(drawn_by, F.lit(seed))
    n = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    drawn = drawn.withColumn("_u", u).withColumn("_n", n).where("_n > 0").drop("_cdf", "_u")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    keyed = copies.withColumn("shuffle_key", shuffle_key(drawn_by, F.col("copy"), F.lit(seed)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", names[key])
    return mixed.toDF(*carried, *mixed.columns[len(carried) :])


def _needed(cdf: list[float]) -> list[float]:
    top = 1 - 2.0**-53
    return cdf[: next((i for i, x in enumerate(cdf) if x >= top), len(cdf) - 1) + 1]
