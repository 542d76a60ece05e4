"""Helpers shared by the corpus operators: stored tables, bounded Arrow batches, private column names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.graph import without_leftovers

#: A word in Spark SQL's regular expressions: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of one Python step together; a single longer text is a step of its own.
STEP_BYTES = 6 << 20
#: Bits of maybe_in(): 8 MB in all, however many keys there are.
BITS = 1 << 26
#: Paths of the tables that stored() has made inside each open scratch().
_inside: list[list[tuple[SparkSession, str]]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    if _inside:
        _inside[-1].append((df.sparkSession, path))
    with without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that stored() makes inside are deleted in the end."""
    _inside.append([])
    try:
        yield
    finally:
        for spark, path in _inside.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def maybe_in(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``maybe``: false only where ``keys`` has no row of the same ``columns``, which are not null.

    A bit for each key's hash is sent to all tasks, so ``rows`` needs no shuffle to leave out most of what isn't wanted.
    The more keys, the more rows are wrongly marked, never one too few.
    """
    h = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    # dealt out first, else each task would send a map of all bits
    bits = keys.select(h.alias("h_")).withColumn("bucket_", F.bitmap_bucket_number("h_")).repartition("bucket_").groupBy("bucket_").agg(F.bitmap_construct_agg(F.bitmap_bit_position("h_")).alias("bits_"))
    at = F.bitmap_bit_position("h_")
    byte = F.conv(F.hex(F.substring("bits_", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))
    found = rows.withColumn("h_", h).withColumn("bucket_", F.bitmap_bucket_number("h_")).join(F.broadcast(bits), "bucket_", "left")
    return found.withColumn("maybe", hit).select(*[F.col(f"`{c}`") for c in rows.columns], "maybe")


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(k)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in ``column`` hold at most ``most`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts; null reads as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as UTF-8; null reads as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def with_arrow(df: DataFrame, fields: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append columns computed in Python from bounded slices of each partition.

    ``make`` runs once a task and gives the function from a slice to one list or array for each field.
    Columns of ``df`` named like a new field, in whatever case, are replaced; ``keep`` narrows what is passed on.
    """
    new = {f.name.lower() for f in fields}
    have = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    base = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*have, text])])
    drop_text = text not in have
    out = T.StructType([f for f in base.schema if f.name != text or not drop_text] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, schema = make(), to_arrow_schema(out)
        for batch in batches:
            for part in steps(batch, text):
                made = step(part)
                old = [part.column(c) for c in part.schema.names if c != text or not drop_text]
                cols = [*old, *(x if isinstance(x, pa.Array) else pa.array(x, schema.field(len(old) + i).type) for i, x in enumerate(made))]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return base.mapInArrow(run, out)


def window_of(text: Column, h: Column, most: int) -> Column:
    """``most`` characters of a text from a place that ``h`` gives, anywhere in it; the whole text if it is no longer."""
    return F.substring(text, F.lit(1) + F.pmod(h, F.greatest(F.lit(1), F.length(text) - F.lit(most - 1))).cast("int"), F.lit(most))


def private(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with column names that no operator uses, and the text column's; public() gives the old ones back."""
    names = [f"own_{i}__" for i in range(len(df.columns))]
    return df.toDF(*names), names[df.columns.index(text)]


def public(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that private() renamed, alone and with their old names."""
    return df.select(*[f"own_{i}__" for i in range(len(columns))]).toDF(*columns)
