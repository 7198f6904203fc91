"""Range joins: each reference's innermost enclosing definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def innermost(definitions: DataFrame, references: DataFrame, group: str, begin: str, end: str, at: str, name: str, bucket: int = 64) -> DataFrame:
    """references with the name of the smallest definition of the group that encloses them; those without one are dropped.

    definitions has group, begin, end and name, references group and at, in numbers.  Positions are cut into buckets; a
    definition is at each of its buckets, so the join is on group and bucket.  The smallest has the least length; of
    equals the earliest begin and then the smallest name counts.
    """
    spread = definitions.select(group, begin, end, name, F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor(F.col(end) / bucket))).alias("_b"))
    placed = references.withColumn("_b", F.floor(F.col(at) / bucket))
    met = placed.join(spread, [group, "_b"]).where((F.col(begin) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = F.min(F.struct((F.col(end) - F.col(begin)).alias("n"), F.col(begin).alias("b"), F.col(name).alias("name")))
    return met.groupBy(*references.columns).agg(best.alias("_m")).select(*references.columns, F.col("_m.name").alias(name))


def normal_range(r: Column) -> Column:
    """Three numbers (line, from, to) or four to a struct; others raise."""
    three = F.struct(r[0].alias("line"), r[1].alias("char"), r[0].alias("end_line"), F.try_element_at(r, F.lit(3)).alias("end_char"))
    four = F.struct(r[0].alias("line"), r[1].alias("char"), F.try_element_at(r, F.lit(3)).alias("end_line"), F.try_element_at(r, F.lit(4)).alias("end_char"))
    return F.when(F.size(r) == 3, three).when(F.size(r) == 4, four).otherwise(F.raise_error(F.concat(F.lit("a range has 3 or 4 numbers, not "), F.size(r).cast("string"))))
