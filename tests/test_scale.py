"""Work on the driver's tables goes to all tasks."""

from pyspark.sql import functions as F

from strataweave import catalog_more
from strataweave.sources.fixture import Fixture

SMALL = "/root/testdata/sf0.001"


def test_texts_of_a_table_in_one_file_are_parsed_by_several_tasks(spark):
    texts = catalog_more._texts(Fixture(spark, SMALL))
    assert texts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 4
    assert texts.select(F.spark_partition_id()).distinct().count() > 4
