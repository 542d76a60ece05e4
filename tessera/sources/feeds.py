"""Readers of what outside services give: map elements and certificates as JSON, lines and titles as text.

Each has a stated schema. A line that does not fit comes back as rejected, with what it said, and stops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "id long, tags map<string,string>"
CERTIFICATE = "name_value string"
BROKEN = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): one JSON object a line; rejected (line, reason) are not JSON, of another type, or lack a needed field."""
    d = spark.read.schema(f"{schema}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    lacks = F.coalesce(*[F.when(F.col(c).isNull(), f"no {c}") for c in needed])
    reason = F.when(F.col(BROKEN).isNotNull(), "not readable").otherwise(lacks)
    names = [c for c in d.columns if c != BROKEN]
    d = d.withColumn("reason", reason)
    rejected = d.where("reason is not null").select(F.coalesce(BROKEN, F.to_json(F.struct(*names))).alias("line"), "reason")
    return d.where("reason is null").select(*names), rejected


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Map elements (id, tags)."""
    return json_lines(spark, path, ELEMENT, ["id", "tags"])


def certificates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Certificates (name_value: names, one a line)."""
    return json_lines(spark, path, CERTIFICATE, ["name_value"])


def lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """Lines of text files, such as seeds and titles."""
    return spark.read.text(path).withColumnRenamed("value", column)
