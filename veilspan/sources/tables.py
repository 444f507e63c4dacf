"""Reading the input tables through Spark's readers, whatever store they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table that has fewer splits than the session has cores to all cores.

    Splits are cut by size, so only small tables are dealt: a large one has more splits than cores and
    stays as it lies. Worth the shuffle for work that is heavy on the processor, such as pattern scans."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
