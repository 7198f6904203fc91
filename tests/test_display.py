"""Numbers as texts."""

from pyspark.sql import functions as F

from strataweave.functions import display


def test_decimals_round_what_the_double_is(spark):
    """As C's and DuckDB's printf: 9.45 is a little less than its digits, 10.85 too, and halves go to the even digit."""
    rows = spark.createDataFrame([(9450, "9.4k"), (10850, "10.8k"), (1150, "1.1k"), (1250, "1.2k"), (1750, "1.8k"), (1050, "1.1k"), (1000, "1.0k"), (999, "999"), (2345678, "2345.7k")], "n int, text string")
    assert rows.select(display.short_number(F.col("n")).alias("got"), "text").where("got is distinct from text").collect() == []
    scores = spark.createDataFrame([(0.125, "0.12"), (0.375, "0.38"), (0.145, "0.14"), (0.0, "0.00"), (1234.5, "1234.50"), (None, None)], "x double, text string")
    assert scores.select(display.decimals(F.col("x"), 2).alias("got"), "text").where("got is distinct from text").collect() == []
