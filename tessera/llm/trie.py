"""Conversation prefix trie by whole sequences: identical conversations collapse into one weighted sequence, sequences that
are proper prefixes of others are no leaves, and all prefixes are aggregated by weight.

Turns are known by digests, prefixes by chained digests, so no text is shuffled. A node's turns are the first ``depth`` turns
of its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Bytes of a prefix's digest. The root's is all zeros.
KEY = 16
ROOT = bytes(KEY)
#: Ids of one range of 2^ID_BITS that end at a node are joined before they meet the others.
ID_BITS = 12
#: keys: digest of each prefix, the root first. rest: bytes of the texts from that depth on (those of depth 1 at the root).
SEQUENCE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("keys", T.ArrayType(T.BinaryType())), T.StructField("rest", T.ArrayType(T.LongType()))])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and text bytes of each turn, in order.

    In order of turn, null first; turns of one number by role and digest. Null roles and texts are empty; rows without a
    conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length keeps role and text apart
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("turn"))
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5, then c's own turns after its first h; h = crc32(c) % 9."""
    own = stored(turn_lists(conversations), "turns")
    base = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, 8).alias("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base_id"), "left")
    none = F.array().cast(own.schema["turns"].dataType)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("base", F.lit(1), h), none), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def chained(turns: DataFrame) -> DataFrame:
    """SEQUENCE rows of conversations (conv_id, turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rests = [], []
            # one conversation at a time becomes Python objects
            for turns in (x.as_py() for x in batch.column("turns")):
                key, of = ROOT, [ROOT]
                for t in turns:
                    key = hashlib.blake2b(key + t["digest"], digest_size=KEY).digest()
                    of.append(key)
                rest = [0]
                for t in reversed(turns):
                    rest.append(rest[-1] + t["bytes"])
                rests.append([rest[-1], *rest[:0:-1]])
                keys.append(of)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, pa.list_(pa.binary())), pa.array(rests, pa.list_(pa.int64()))], names=["conv_id", "keys", "rest"])

    return turns.select("conv_id", "turns").mapInArrow(run, SEQUENCE)


def ends(sequences: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending and joined by commas.

    Ids are joined by ranges first, in as many tasks as there are ranges. The parts of one node then pass in order through
    one digest that is all that is held, since SHA-256 can only be taken from front to back.
    """
    part = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    parts = sequences.select(F.element_at("keys", -1).alias("key"), "conv_id", F.shiftright("conv_id", ID_BITS).alias("part")).groupBy("key", "part").agg(part.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, said = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if digest:
                        keys.append(now)
                        said.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(said, pa.string())], names=["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def collapsed(sequences: DataFrame) -> DataFrame:
    """One row of each distinct sequence: its smallest conversation (low), how many there are (weight), and whether it is a leaf."""
    whole = sequences.groupBy(F.element_at("keys", -1).alias("key")).agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    whole = stored(whole.join(sequences.select(F.col("conv_id").alias("low"), "keys", "rest"), "low"), "distinct")
    inner = whole.select(F.explode(F.slice("keys", F.lit(1), F.size("keys") - 1)).alias("key")).distinct()
    leaves, others = whole.join(inner, "key", "left_anti"), whole.join(inner, "key", "left_semi")
    return leaves.withColumn("leaf", F.lit(1)).unionByName(others.withColumn("leaf", F.lit(0)))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie's nodes (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    saved_tokens is what sharing a node's last text saves, over its subtree: the bytes of all its members from this depth on
    less those of its distinct nodes. Each node is counted once: it belongs to the sequence of its smallest member, and the
    nodes that a sequence has for itself are its last ones, so their first depth says which.
    No conversations: no nodes. A conversation without turns ends at the root.
    """
    sequences = stored(sequences, "sequences")
    whole = stored(collapsed(sequences), "weighted")
    at = F.posexplode("keys").alias("depth", "key")
    parent = F.when(F.col("depth") > 0, F.get("keys", F.col("depth") - 1))
    rows = whole.select("low", "weight", "leaf", "keys", "rest", at).select("low", "weight", "leaf", "key", parent.alias("parent"), F.col("depth").cast("long").alias("depth"), (F.col("weight") * F.get("rest", F.col("depth"))).alias("all_bytes"))
    nodes = stored(rows.groupBy("key", "parent", "depth").agg(F.min("low").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("all_bytes").alias("all_bytes")), "nodes")
    first = nodes.groupBy(F.col("conv_id").alias("low")).agg(F.min("depth").cast("int").alias("first"))
    own = whole.join(first, "low").select("rest", "first", at)
    own = own.select("key", F.get("rest", F.greatest("depth", "first")).alias("own_bytes")).groupBy("key").agg(F.sum("own_bytes").alias("own_bytes"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    d = nodes.join(own, "key").join(children, "key", "left").join(ends(sequences), "key", "left").join(parents, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return d.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", (F.col("all_bytes") - F.col("own_bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


__all__ = ["chained", "collapsed", "ends", "prefix_trie", "rebuilt", "turn_lists"]
