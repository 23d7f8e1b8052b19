"""Session settings: what they bound."""

from pyspark.sql import functions as F

from leakaudit import configure


def test_merged_partitions_are_small(spark):
    """40 MB of shuffle files on 8 cores: merged to the cores alone, a task would take 5 MB and more as input grows."""
    configure(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        kinds = spark.range(0, 4_000_000, 1, 8).groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n"))
        per_task = kinds.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(r["count"] for r in per_task) == 4_000_000
    assert len(per_task) > 10
