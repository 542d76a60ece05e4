"""Best-fit packing of token sequences, hierarchical: partitions pack locally and emit nearly full bins; all other bins
go up a tree as items, best-fit again at each node. A bin that finds no partner at its node is pieces again, and what the
tree leaves is packed together, by how many pieces there are of each length."""

from __future__ import annotations

import zlib
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, stored, texts_of
from .tokens import encoder

#: Bins this near to full leave at once.
SLACK = 8
#: Pieces that a task packs at a time.
LOCAL = 200_000
#: Nodes that meet in one of the next round of the tree.
FAN = 16
#: Sequences of the last round are numbered from here.
UPPER = 1 << 60
PLACED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("at", T.LongType()), T.StructField("node", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("up", T.BooleanType()), T.StructField("fill", T.LongType()),
])
#: A local bin in the bin ``root`` of the tree, from offset ``base`` on; the root's fill and node.
BRANCH = T.StructType([T.StructField(c, T.LongType()) for c in ("bin", "root", "base", "fill", "node")])


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the fill of each bin.

    Bins with the same room are one stack, and a bit mask tells which rooms exist, so an item costs the same however
    many bins are open.
    """
    place, at, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_, mask = {}, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need << need
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        place[i], at[i] = b, fill[b]
        fill[b] += need
        if room > need:
            open_.setdefault(room - need, []).append(b)
            mask |= 1 << (room - need)
    return place, at, np.array(fill, np.int64)


def ranks(length: np.ndarray) -> np.ndarray:
    """How many equal lengths stand before each."""
    order = np.argsort(length, kind="stable")
    put = length[order]
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.searchsorted(put, put)
    return out


def best_fit_counts(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing of ``counts`` pieces of each length, as rows (length, rank, bin, each, at) by length and rank.

    From the piece of this rank on, pieces of the length fill bins from ``bin`` on, ``each`` to a bin, the first at
    offset ``at``. Bins that hold the same are one range, and a length splits two ranges at most besides those that it
    fills, so the work depends on ``size``, not on how many pieces there are.
    """
    out, open_, mask, made = [], {}, 0, 0
    for need in sorted(counts, reverse=True):
        n, done = counts[need], 0
        while n:
            fits = mask >> need << need
            if fits:
                room = (fits & -fits).bit_length() - 1
                lo, hi = open_[room].pop()
                if not open_[room]:
                    mask &= ~(1 << room)
            else:
                room, lo = size, made
                made = hi = lo + -(-n // (size // need))
            each = min(room // need, n)
            full = min(hi - lo, n // each)
            out.append((need, done, lo, each, size - room))
            done, n = done + full * each, n - full * each
            for a, b, left in ((lo, lo + full, room - each * need), (lo + full, hi, room)):
                if a < b and left:
                    open_.setdefault(left, []).append((a, b))
                    mask |= 1 << left
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def local_round(docs: DataFrame, vocab_path: str, size: int, end_id: int, spaces: str) -> DataFrame:
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        enc, schema, end = encoder(vocab_path, spaces), to_arrow_schema(PLACED), np.array([end_id], "<u4").tobytes()
        part, used, flushed = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []

        def flush():
            nonlocal rows, used, flushed
            length = np.array([r[3] for r in rows], np.int64)
            place, at, fill = best_fit(length, size)
            up = (fill < size - SLACK)[place]
            rank = np.zeros(len(length), np.int64)
            rank[up] = ranks(length[up])
            name, node = (np.int64(part) << 36) + used + place, (np.int64(part) << 36) + flushed
            used, flushed = used + len(fill), flushed + 1
            cols = list(zip(*rows, strict=True))
            rows = []
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(length), pa.array(cols[4], pa.int64()),
                pa.array(name), pa.array(at), pa.array(np.full(len(name), node, np.int64)), pa.array(rank), pa.array(up), pa.array(fill[place]),
            ], schema=schema)

        for b in chain.from_iterable(steps(b, "text") for b in batches):
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(texts_of(b, "text")), strict=True):
                ids = x + end
                n = len(ids) // 4
                first = n % size or size
                for k, start in enumerate([0, *range(first, n, size)]):
                    stop = first if k == 0 else start + size
                    rows.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                if len(rows) >= LOCAL:
                    yield flush()
        if rows:
            yield flush()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, PLACED)


def tree_round(branches: DataFrame, size: int) -> DataFrame:
    """Roots as items, best-fit decreasing at each node: the branches (BRANCH) of those that found a partner.

    A new root is named after its first item. A node's rows lie in one task. Of the bins that best-fit leaves, one at
    most is half full or less, and of two partners one is; so after the first round a node gets FAN * FAN roots at most.
    """

    def merge(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_numpy() for n in BRANCH.names}
        roots, first, item = np.unique(c["root"], return_index=True, return_inverse=True)
        place, at, fill = best_fit(c["fill"][first], size)
        name = np.empty(len(fill), np.int64)
        name[place[at == 0]] = roots[at == 0]
        met = (np.bincount(place) > 1)[place[item]]
        new = {"bin": c["bin"], "root": name[place[item]], "base": c["base"] + at[item], "fill": fill[place[item]], "node": c["node"]}
        return pa.table({n: pa.array(x[met], pa.int64()) for n, x in new.items()})

    return branches.groupBy("node").applyInArrow(merge, BRANCH)


def tree(placed: DataFrame, size: int) -> DataFrame | None:
    """Branches of the nearly full roots of all rounds; None where there is one node at most, so nothing to merge."""
    bins = placed.where("up and at = 0")
    nodes, node, out = bins.select("node").distinct().count(), F.xxhash64("node"), []
    branches = bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("base"), "fill", "node")
    while nodes > 1:
        nodes = -(-nodes // FAN)
        met = stored(tree_round(branches.withColumn("node", F.pmod(node, F.lit(nodes))), size), "branches")
        full = F.col("fill") >= size - SLACK
        out.append(met.where(full))
        branches, node = met.where(~full), F.col("node")
        if branches.isEmpty():
            break
    return reduce(DataFrame.unionByName, out) if out else None


def last_round(rest: DataFrame, holes: DataFrame | None, size: int) -> DataFrame:
    """Bins and offsets of the pieces that are left: each has a rank among all of its length, which says where it goes.

    ``holes`` (node, length, gone) are the ranks of pieces that left by the tree. The driver holds the counts of
    ``size`` lengths; which pieces they are stays with the executors.
    """
    here = rest.groupBy("node", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = best_fit_counts({r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    shift = here.select("node", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rank = F.col("rank") + F.col("shift")
    if holes is not None:
        shift = shift.join(holes, ["node", "length"], "left")
        gone = F.coalesce("gone", F.array().cast("array<bigint>"))
        rank -= F.size(F.filter(gone, lambda x: x < F.col("rank")))
    held = rest.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        need, first, lo, each, base = held.value.T
        key = (need << 48) + first
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, (length << 48) + rank, "right") - 1
            k = rank - first[i]
            new = {"bin": UPPER + lo[i] + k // each[i], "at": base[i] + k % each[i] * length}
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else b.column(j) for j, c in enumerate(b.schema.names)], names=b.schema.names)

    ranked = rest.join(shift, ["node", "length"]).withColumn("rank", rank).select(*PLACED.names)
    return ranked.mapInArrow(run, PLACED)


def upper_rounds(placed: DataFrame, size: int) -> DataFrame:
    """Pieces of underfull bins (PLACED): those that the tree fills, and those of the last round."""
    up, full = placed.where("up"), tree(placed, size)
    if full is None:
        return last_round(up, None, size)
    up = up.join(full.select("bin", "root", "base"), "bin", "left")
    met = up.where("root is not null")
    holes = met.groupBy("node", "length").agg(F.collect_list("rank").alias("gone"))
    filled = met.withColumns({"bin": F.col("root"), "at": F.col("at") + F.col("base")}).select(*PLACED.names)
    return filled.unionByName(last_round(up.where("root is null").select(*PLACED.names), holes, size))


def pack_documents(docs: DataFrame, vocab_path: str, size: int = 1024, end_id: int = 2, spaces: str = "leading") -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``size`` tokens.

    A document is its ids and then ``end_id``; only longer ones are cut, the first piece being the shorter one.
    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts hold the end id alone.
    Repeated rows are packed each. Other columns are ignored. An empty table gives an empty result. A task holds the
    lengths of LOCAL pieces, or the underfull bins of about FAN such; a sequence leaves its partition or the tree only
    when SLACK tokens at most are free in it.
    """
    placed = stored(local_round(docs, vocab_path, size, end_id, spaces), "placed")
    out = placed.where("not up").unionByName(upper_rounds(placed, size))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
