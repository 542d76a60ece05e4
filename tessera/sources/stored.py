"""Tables that stay between runs: appended by date, merged by bucket, dropped by profile. Nothing else of them is rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import kept

BUCKETS = 64


def overwrite_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace those partitions of a table that ``rows`` has, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def gathered(rows: DataFrame, by: str) -> DataFrame:
    """Rows of one folder in one task, but in several where they are many, so that a task's rows don't grow with the table."""
    return rows.hint("rebalance", F.col(by))


def append_dated(rows: DataFrame, path: str, time: str, batch: int) -> None:
    """Append rows by the date of ``time``, as one batch: a batch that runs again replaces what it wrote."""
    overwrite_partitions(rows.withColumns({"on": F.to_date(time), "batch": F.lit(batch)}), path, ["on", "batch"])


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table in folders by the hash of its keys, one file or more for each."""
    gathered(rows.withColumn("bucket", bucket_of(keys, buckets)), "bucket").write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def merge_buckets(path: str, new: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """``merge`` (target, new) over the buckets of a written table that ``new`` touches; their numbers.

    Only these are read and written again. The result is stored beside the table before it replaces the folders, so a job that
    fails in between changes nothing, and one that runs again does the same. A bucket that is left without rows is removed.
    """
    spark = new.sparkSession
    new = kept(new, "merge_new")
    # at most ``buckets`` numbers
    touched = sorted(r[0] for r in new.select(bucket_of(keys, buckets).alias("b")).distinct().collect())
    target = read_buckets(spark, path).where(F.col("bucket").isin(touched)).drop("bucket")
    merged = kept(merge(target, new).withColumn("bucket", bucket_of(keys, buckets)), "merged")
    left = {r[0] for r in merged.select("bucket").distinct().collect()}
    overwrite_partitions(gathered(merged, "bucket"), path, ["bucket"])
    for b in touched:
        if b not in left:
            remove(spark, f"{path}/bucket={b}")
    return touched


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder, on any file system that Spark reads; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def write_profiles(rows: DataFrame, path: str) -> None:
    """A table in folders by profile_id, one file or more for each."""
    gathered(rows, "profile_id").write.partitionBy("profile_id").parquet(path)
