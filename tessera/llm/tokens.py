"""Tokenizer ids of whole texts, with the pieces' ids remembered, and files of ids packed in the fewest bits."""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_root, steps, stored, texts_of

#: Remembered pieces between spaces, remembered parts of pieces, and the longest part worth remembering.
PIECES, PARTS, LONGEST = 250_000, 600_000, 48
#: How the tokenizers' own files split a piece, by what becomes of spaces.
SPLIT = {
    "dropped": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
    "leading": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
#: Byte-level vocabularies write a byte as a letter: printable Latin-1 as itself, the others as the code points from 256.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
SPACED = re.compile(r" (?:\s|$)")


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizer's ids as little-endian unsigned 32-bit bytes.

    A text is split where the tokenizer splits it in any case, first at spaces, then by its file's own rule (``spaces``:
    "dropped" or "leading"), so that a part's ids don't depend on its neighbours; each part is given to the library once.
    Texts that hold a special token's opening, and pieces with characters beyond Latin-1, are given to it whole.
    """

    def __init__(self, path: str, spaces: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab = self.tokenizer.get_vocab_size()
        self.leading, self.split = spaces == "leading", regex.compile(SPLIT[spaces]).findall
        self.pieces = Remembered(self.piece)
        self.parts: dict[str, bytes] = {}

    def part(self, x: str) -> bytes:
        """Ids of a part that the splitting rule gave, from the library's model, which reads bytes as letters."""
        ids = [t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(LETTERS))]
        got = array("I", ids).tobytes()
        if len(x) <= LONGEST:
            self.parts[x] = got
        return got

    def piece(self, p: str) -> bytes:
        """Ids of a piece; with leading spaces kept, it is written without its own."""
        whole = " " + p if self.leading else p
        if not p.isascii() and max(p) > "\u00ff":
            return self.library(whole)
        parts, part = self.parts, self.part
        return b"".join([parts.get(x) or part(x) for x in self.split(whole if self.leading else whole.lower())])

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The dictionaries hold no cycles, so the cyclic garbage collector only costs time here."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        if len(self.parts) > PARTS:
            self.parts.clear()
        get, out = self.pieces.__getitem__, []
        for text in texts:
            if "<|" in text:
                out.append(self.library(text))
            elif not self.leading:
                out.append(b"".join(map(get, text.replace("\n", " ").split(" "))))
            else:
                first, *rest = text.split(" ")
                if SPACED.search(text):
                    # a space before white space or at the end belongs to the piece before it
                    cut = [first]
                    for x in rest:
                        if x and not x[0].isspace():
                            cut.append(x)
                        else:
                            cut[-1] += " " + x
                    first, *rest = cut
                out.append(self.library(first) + b"".join(map(get, rest)))
        return out


class Remembered(dict):
    """Ids of pieces, found when first asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, p: str) -> bytes:
        got = self.find(p)
        if len(p) <= LONGEST:
            self[p] = got
        return got


@lru_cache(2)
def encoder(path: str, spaces: str) -> Encoder:
    """One encoder a worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, spaces)


# --- ids packed in the fewest bits -------------------------------------------------------------------------------

#: Ids in a block; each block starts at a byte, and its offset is in the index.
BLOCK = 1024


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, most significant first; zero bits fill the last byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    spread = (ids[:, None].astype(np.uint32) >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of what pack() gave."""
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def pack_shard(ids: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Payload and index of a shard: the index holds each block's byte offset (little-endian unsigned 64 bits) and the end."""
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return b"".join(blocks), offsets.tobytes()


def read_ids(payload: bytes, index: bytes, start: int, stop: int, bits: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only the blocks that hold them are unpacked."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(index, "<u8")
    first, last = start // BLOCK, (stop - 1) // BLOCK
    full = (last + 1) * BLOCK
    if bits * BLOCK % 8 == 0:
        # blocks but the shard's last are full bytes without gaps, so several unpack at once
        data = payload[int(offsets[first]) : int(offsets[last + 1])]
        n = min(full - first * BLOCK, len(data) * 8 // bits)
        return unpack(data, n, bits)[start - first * BLOCK : stop - first * BLOCK]
    parts = [unpack(payload[int(offsets[b]) : int(offsets[b + 1])], min(BLOCK, int(offsets[b + 1] - offsets[b]) * 8 // bits), bits) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]


SHARD = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("bits", T.IntegerType()),
    T.StructField("doc_ids", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("index", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
#: Ids of a shard, unless one document has more.
SHARD_IDS = 1 << 20


def write_token_files(docs: DataFrame, path: str, vocab_path: str, end_id: int = 1, spaces: str = "dropped") -> None:
    """Token files of ``docs`` (doc_id, text) in ascending doc_id order under ``path``.

    A Parquet row is a shard: ids in ceil(log2(vocabulary)) bits, block offsets, the documents' ids and lengths.
    ``part`` and ``shard`` give the order. Null and empty texts hold the end id alone. Null ids come first. Repeated
    rows are written each. Other columns are ignored. An empty table gives no shards.
    """
    from pyspark import TaskContext

    def run(batches):
        from itertools import chain

        from pyspark.sql.pandas.types import to_arrow_schema

        enc, schema = encoder(vocab_path, spaces), to_arrow_schema(SHARD)
        bits, part, end = max(1, (enc.vocab - 1).bit_length()), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        ids, held, lengths, n, shard = [], [], [], 0, 0

        def flush():
            flat = np.frombuffer(b"".join(ids), "<u4")
            payload, index = pack_shard(flat, bits)
            row = [part, shard, len(flat), bits, np.array(held, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), index, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in chain.from_iterable(steps(b, "text") for b in batches):
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(texts_of(b, "text")), strict=True):
                ids.append(x + end)
                held.append(NO_ID if doc is None else doc)
                lengths.append(len(x) // 4 + 1)
                n += lengths[-1]
                if n >= SHARD_IDS:
                    yield flush()
                    ids, held, lengths, n, shard = [], [], [], 0, shard + 1
        if held:
            yield flush()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    d.mapInArrow(run, SHARD).write.parquet(path)


NO_ID = -(2**63)


def read_token_files(docs_path: str, spark) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    ``start`` counts the ids of all documents before it: running sums over parts (one row a part) and over the shards
    of a part; the shards' own ids stay where they are.
    """
    files = spark.read.schema(SHARD).parquet(docs_path)
    n = files.groupBy("part", "shard").agg(F.first("n_ids").alias("n"))
    parts = n.groupBy("part").agg(F.sum("n").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = n.join(parts.withColumn("before", before), "part").withColumn("base", F.col("before") + inside).select("part", "shard", "base")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(READ)
        for batch in batches:
            for r in batch.to_pylist():
                docs, lengths = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<i8")
                ids = read_ids(r["payload"], r["index"], 0, r["n_ids"], r["bits"]).astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(docs), r["part"], np.int32)), pa.array(np.full(len(docs), r["shard"], np.int64)), pa.array(docs, mask=docs == NO_ID),
                    pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                ], schema=schema)

    rows = files.mapInArrow(run, READ)
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")


READ = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("inner_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_table(docs: DataFrame, vocab_path: str, end_id: int = 1, spaces: str = "dropped") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read the documents back from them."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_root(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocab_path, end_id, spaces)
    return read_token_files(path, spark)


__all__ = ["Encoder", "encoder", "pack", "pack_shard", "read_ids", "read_token_files", "stored", "token_table", "unpack", "vocabulary_file", "write_token_files"]
