"""Merges of new rows into a target: a new frame each time, since Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Add new rows whose key is absent; of new rows with one key the first by ``order`` (default: all columns) counts."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in new.columns]))
    one = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return target.unionByName(one.join(target.select(*keys), keys, "left_anti"))


def upsert_replace(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest write of each key by ``order``; a new row beats an old one in a tie."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = both.groupBy(*keys).agg(F.max(F.struct(*order, F.col("_new").alias("_new_"), F.struct(*target.columns).alias("_row"))).alias("_top"))
    return latest.select([F.col(f"_top._row.{c}").alias(c) for c in target.columns])


def upsert_accumulate(target: DataFrame, new: DataFrame, keys: list[str], sums: list[str], last: str, runs: str = "runs") -> DataFrame:
    """Counters add up, ``last`` takes the latest time, ``runs`` grows by one for each new row."""
    both = target.unionByName(new.withColumn(runs, F.lit(1).cast("long")))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max(last).alias(last), F.sum(runs).alias(runs))


def latest_runs(runs: DataFrame, most: int = 8) -> DataFrame:
    """The runs that started last."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)
