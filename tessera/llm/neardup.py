"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, and groups of links."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.graph import components

from .common import bytes_of, maybe_in, scratch, steps, stored, with_arrow

#: Bands of so many signature slots. A pair at similarity 0.8 misses all of them once in 3 million times.
BANDS, ROWS = 38, 5
#: Members of a hub are paired with each other where at most so many of those that meet at an edit aren't linked with it, or are outside the largest component there.
FEW = 16
#: Pairs of a hub's members a set from which on components are looked at, and pairs a set that are compared between two looks.
DENSE, WAVE = 4, 2
#: Shingles handled together; a larger set is handled in parts, whose slot minima are the set's.
TOGETHER = 60_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SET = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingle_hashes(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * GOLDEN + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def shingle_set(text: bytes, words: int) -> set:
    """The shingles themselves, for verification."""
    found = text.lower().split()
    k = min(words, len(found))
    return set(zip(*(found[i:] for i in range(k)), strict=False)) if found else set()


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, (sets, m).

    Step j gives each element one value in [j, j + 1) for the slot at place j of its own random permutation, drawn
    lazily by swaps, so an element's slots differ. A set whose slots all hold values below j + 1 can't change and leaves.
    """
    out = np.full((len(sets), m), np.inf)
    todo = [(i, s[k : k + TOGETHER]) for i, s in enumerate(sets) for k in range(0, len(s), TOGETHER)]
    while todo:
        some, n = [], 0
        while todo and (not some or n + len(todo[-1][1]) <= TOGETHER):
            some.append(todo.pop())
            n += len(some[-1][1])
        value = np.concatenate([s for _, s in some])
        owner = np.repeat(np.arange(len(some)), [len(s) for _, s in some])
        h = np.full((len(some), m), np.inf)
        flat = h.ravel()
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (n, 1))
        row = np.arange(n)
        for j in range(m):
            r = mixed(value + np.uint64((j + 1) * int(GOLDEN) & (1 << 64) - 1))
            k = j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            np.minimum.at(flat, owner * m + slot, j + (r >> np.uint64(32)).astype(np.float64) / 2**32)
            left = (h.max(1) >= j + 1)[owner]
            count = int(left.sum())
            if not count:
                break
            if count < 0.7 * len(row):
                value, owner, perm = value[left], owner[left], perm[left]
                row = np.arange(count)
        for (i, _), x in zip(some, h, strict=True):
            np.minimum(out[i], x, out=out[i])
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of a signature; the band's number is part of it."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for i in range(rows):
        out = mixed(out * GOLDEN + bits[:, :, i])
    return out.view(np.int64)


def least_size(percent: int) -> int:
    """Sets below this size can't reach the similarity with another set: s / (s + 1) is the most."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def shingled(docs: DataFrame, words: int, percent: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the set's size, its fingerprint, and its band hashes where another set can be near it."""
    least = least_size(percent)

    def make():
        known = WordHashes()

        def step(batch: pa.RecordBatch) -> list:
            sets = [shingle_hashes(x, words, known) for x in bytes_of(batch, text)]
            banded = [i for i, s in enumerate(sets) if len(s) >= least]
            bands: list = [None] * len(sets)
            if banded:
                for i, b in zip(banded, band_hashes(super_minhash([sets[i] for i in banded], BANDS * ROWS), BANDS, ROWS).tolist(), strict=True):
                    bands[i] = b
            return [[len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], bands]

        return step

    return with_arrow(docs, SET, make, text, keep)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) compared on the full shingle sets of their texts (id, text).

    ``linked``: whether they are at the similarity or above; ``size_a``, ``size_b``: of the sets; ``edits``: hashes of the
    shingles that only one of them has.
    """

    def run(batches):
        import xxhash
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(COMPARED)
        last, held = None, set()
        for batch in (b for x in batches for b in steps(x, "text_a")):
            rows: list[list] = [[] for _ in COMPARED]
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), bytes_of(batch, "text_a"), bytes_of(batch, "text_b"), strict=True):
                if b != last:
                    last, held = b, shingle_set(y, words)
                own = shingle_set(x, words)
                both = len(own & held)
                linked = 100 * both >= percent * (len(own) + len(held) - both)
                edits = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(s)) for s in own ^ held), np.uint64, len(own) + len(held) - 2 * both).view(np.int64)
                for c, v in zip(rows, (a, b, linked, len(own), len(held), edits), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, COMPARED)


COMPARED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType()), T.StructField("size_a", T.LongType()), T.StructField("size_b", T.LongType()), T.StructField("edits", T.ArrayType(T.LongType()))])


def next_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, deep): pairs of members of one hub that may be linked though one of them isn't linked with the hub.

    ``rows``: members (a, meets) compared with their hub (b). Two sets x, y with edits X, Y against the hub p differ in
    X xor Y, and are linked when that has at most c(|x| + |y|) elements, c = (100 - percent) / (100 + percent). If x is not
    linked with p, |X| > c(|x| + |p|), so x and y share more than (|Y| + c(|p| - |y|)) / 2 edits, and at least
    (|X| - c(|x| + |p|)) / (1 + c). Sets that share o elements also share one among their first size - o + 1 in any common
    order; the order here is by how many members have an edit, rarest first. So members with edits of their own don't meet.

    Members that meet at an edit are paired with each other where at most FEW of them aren't linked with the hub, or all but
    FEW are in one component (``part``); pairs within a component are left out, since they can't change it. Elsewhere
    members are paired with the first of them alone (``deep``), which is a hub for them in the next round. So a round
    makes a number of pairs in proportion to its rows.
    """
    c = (100 - percent) / (100 + percent)
    m = rows.withColumn("n", F.size("edits"))
    share_y = F.greatest(F.lit(1), F.ceil((F.col("n") + c * (F.col("size_b") - F.col("size_a"))) / 2 - 1e-6))
    share_x = F.greatest(F.lit(1), F.ceil((F.col("n") - c * (F.col("size_a") + F.col("size_b"))) / (1 + c) - 1e-6))
    own = ["a", "b", "part", "linked", "n", "meets", "need", "as_y", "as_x"]
    m = m.withColumns({"as_y": F.col("n") - share_y + 1, "as_x": F.col("n") - share_x + 1, "need": F.col("n") - c * F.col("size_a")}).select(*own, "edits")
    every = m.select(*own, F.explode("edits").alias("edit"))
    often = every.groupBy("b", "edit").agg(F.count(F.lit(1)).alias("often"))
    ranked = every.join(often, ["b", "edit"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("often", "edit"))).alias("ranked"))
    at = ranked.select(*own, F.posexplode("ranked").alias("at", "r")).where("r.often > 1").select("a", "b", "part", "meets", "need", (F.col("n") - F.col("at")).alias("left"), F.col("r.edit").alias("edit"), (F.col("at") < F.col("as_y")).alias("is_y"), (~F.col("linked") & (F.col("at") < F.col("as_x"))).alias("is_x"))
    first = stored(at.where("is_x or is_y"), "prefixes")
    # two sets are linked only where twice what either may still share is as much as both need
    least = first.groupBy("b", "edit").agg(F.count(F.lit(1)).alias("c"), F.max("is_x").alias("any_x"), F.min("need").alias("low")).where("c > 1 and any_x")
    open_ = first.join(least.select("b", "edit", "low"), ["b", "edit"]).where(2 * F.col("left") >= F.col("need") + F.col("low") - 1e-6)
    by_part = open_.groupBy("b", "edit", "part").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("is_x").cast("int")).alias("n_x"), F.min(F.struct((-F.col("meets")).alias("m"), "a")).alias("lead"))
    groups = by_part.groupBy("b", "edit").agg(F.sum("c").alias("c"), F.sum("n_x").alias("n_x"), F.min("lead").alias("lead"), (F.sum("c") - F.max("c")).alias("n_out")).where("n_out > 0 and n_x > 0").drop("c")
    met = stored(open_.drop("low").join(groups, ["b", "edit"]), "met")
    is_few = F.least("n_x", "n_out") <= FEW
    few = met.where(is_few)
    x = few.where("is_x").select("b", "edit", F.col("a").alias("x"), F.col("left").alias("left_x"), F.col("need").alias("need_x"), F.col("meets").alias("meets_x"), F.col("part").alias("part_x"))
    y = few.where("is_y").select("b", "edit", F.col("a").alias("y"), F.col("left").alias("left_y"), F.col("need").alias("need_y"), F.col("meets").alias("meets_y"), F.col("part").alias("part_y"))
    enough = 2 * F.least("left_x", "left_y") >= F.col("need_x") + F.col("need_y") - 1e-6
    leads = F.struct((-F.col("meets_x")).alias("m"), F.col("x").alias("a")) < F.struct((-F.col("meets_y")).alias("m"), F.col("y").alias("a"))
    some = x.join(y, ["b", "edit"]).where((F.col("part_x") != F.col("part_y")) & enough).select(F.when(leads, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(leads, F.col("x")).otherwise(F.col("y")).alias("b"), F.lit(False).alias("deep"))
    many = met.where(~is_few & (F.col("a") != F.col("lead.a"))).select("a", F.col("lead.a").alias("b"), F.lit(True).alias("deep"))
    return some.unionByName(many).groupBy("a", "b").agg(F.max("deep").alias("deep"))


def parts_of(done: DataFrame) -> DataFrame:
    """(node, component) of the links found so far."""
    return stored(components(done.where("linked").select("a", "b")), "parts")


def marked(rows: DataFrame, column: str, parts: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the component of the set in ``column``; a set without links, or without a look at them, is its own."""
    if parts is None:
        return rows.withColumn(name, F.col(column))
    named = parts.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def compared_in_waves(found: DataFrame, done: DataFrame, texts: DataFrame, words: int, percent: int, sets: int) -> DataFrame:
    """``done`` and what comparing ``found`` (a, b, deep) adds to the components.

    Pairs with a hub are all compared. Of the others WAVE for each set are compared at a time, chosen by hash; before
    the next ones, those are left out whose ends are in one component by now. What remains is compared in the end, so the
    components are those of all pairs.
    """
    left = stored(found, "left")
    done = done.unionByName(stored(verified(left.where("deep").select("a", "b"), texts, words, percent), "compared"))
    left, turn = left.where("not deep").select("a", "b"), 0
    while n := left.count():
        waves = -(-n // (WAVE * sets))
        now = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(waves)) == 0
        done = done.unionByName(stored(verified(left.where(now), texts, words, percent), "compared"))
        if waves == 1:
            break
        parts = parts_of(done)
        both = marked(marked(left.where(~now), "a", parts, "part_a"), "b", parts, "part_b")
        left, turn = stored(both.where("part_a <> part_b").select("a", "b"), "left"), turn + 1
    return done


def near_pairs(pairs: DataFrame, meets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) that make the components of all pairs that meet at a hub; ``pairs``: members (a) and hubs (b).

    Members come after their hub in one order of all sets, most meetings first. Where members of a hub remain that may be
    linked without it, the first of them is their hub in the next round: hubs move on in the order, so rounds end, and
    each compares a set once with a hub. Where pairs are many for their sets (letters that differ in a few places, each with a few
    words), pairs whose ends are in one component already are left out, and those of the rest that come first decide.
    """
    ranked = meets.select(F.col("rep").alias("a"), "meets")
    sets = max(1, meets.count())
    dense, turn = pairs.count() > DENSE * sets, 0
    done = stored(verified(pairs, texts, words, percent), "compared")
    deep, rows = pairs, done
    while True:
        parts = parts_of(done) if dense else None
        found = stored(next_pairs(marked(rows.join(ranked, "a"), "a", parts, "part"), percent), "found")
        new = found.join(done, ["a", "b"], "left_anti")
        if dense:
            done = compared_in_waves(new, done, texts, words, percent, sets)
        else:
            done = done.unionByName(stored(verified(new.select("a", "b"), texts, words, percent), "compared"))
        more = stored(found.where("deep").select("a", "b").join(deep, ["a", "b"], "left_anti"), "deep")
        if more.isEmpty():
            return done.where("linked").select("a", "b")
        turn += 1
        dense = dense or turn > 2 or found.count() > DENSE * sets
        deep = deep.unionByName(more)
        hubs = more.select("b").distinct()
        rows = done.join(deep, ["a", "b"], "left_semi").join(hubs, "b", "left_semi")


def class_links(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the class representatives that are near another one.

    ``classes``: rep, text_hash, bands; ``docs``: doc_id, text. A bucket's members are compared with its hub, the one that
    meets most others in buckets. Two members that are both linked with it are in one component; near_pairs() compares
    any other pair of a bucket that may be linked, or finds both linked with a common third. No bucket is cut or dropped.
    """
    with scratch():
        near = classes.where("bands is not null").select("rep", F.explode("bands").alias("key"))
        sizes = near.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = stored(near.join(sizes, "key"), "shared")
        central = stored(shared.groupBy("rep").agg(F.sum("c").alias("meets")), "central")
        hubs = shared.join(central, "rep").groupBy("key").agg(F.max(F.struct("meets", (-F.col("rep")).alias("low"))).alias("hub")).select("key", (-F.col("hub.low")).alias("hub"))
        pairs = stored(shared.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
        wanted = stored(classes.select(F.col("rep").alias("id"), "text_hash").join(central.select(F.col("rep").alias("id")), "id", "left_semi"), "wanted")
        texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
        # few texts are wanted, and a join would send all of them
        texts = maybe_in(texts, wanted, ["id", "text_hash"]).where("maybe").drop("maybe").join(wanted, ["id", "text_hash"], "left_semi")
        texts = stored(texts.select("id", "text").dropDuplicates(["id"]), "texts")
        return components(near_pairs(pairs, central, texts, words, percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their distinct ``words``-word shingles; a
    text of fewer words is one shingle. Null and empty texts have no shingles and no links, like rows without an id,
    which are kept. Equal sets are one class, which its smallest id represents, so copies are never expanded into
    pairs. Repeated rows get equal results. An id with several texts is the document of the text with the smallest hash,
    and all its rows get that one's result. Very long texts are compared whole. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = d.withColumn("text_hash", F.xxhash64("text"))
    sets = stored(shingled(hashed, words, percent, "text", ["doc_id", "text_hash"]), "sets")
    ids = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text_hash", "n_shingles", "same")).alias("one")).select("doc_id", "one.*")
    ids = stored(ids, "ids")
    reps = ids.where("same is not null").groupBy("same").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    reps = stored(reps.select("same", F.col("one.doc_id").alias("rep"), "one.text_hash"), "reps")
    with scratch():
        # band hashes are most of what is moved, so only those of representatives are, and once
        bands = sets.select(F.col("doc_id").alias("rep"), "text_hash", "bands").join(reps.select("rep", "text_hash"), ["rep", "text_hash"], "left_semi")
        groups = class_links(stored(bands.dropDuplicates(["rep", "text_hash"]), "classes"), d, words, percent)
    classes = reps.select("same", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    by_id = ids.select("doc_id", "n_shingles", "same").join(classes, "same", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sets.where("doc_id is not null").select("doc_id").join(by_id, "doc_id").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    none = sets.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group, with their own columns, whatever their names.

    Rows that repeat an id are one document: the row with the smallest text hash stays, or of equal texts any. Rows
    without an id stay, each; null and empty texts are in no group and stay; an empty table gives an empty result.
    """
    found = near_duplicates(docs, words, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("id_")).agg(F.first("kept").alias("kept_"), F.count(F.lit(1)).alias("n_"))
    found = stored(found, "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    named = docs.select(F.col("doc_id").cast("long").alias("id_"), row, F.xxhash64(F.col("text").cast("string")).alias("hash_"))
    # a row that surely is neither a duplicate nor one of several of its id stays where it is; of the others, each is looked up
    named = maybe_in(named, found.where("not kept_ or n_ > 1"), ["id_"])
    sure, some = named.where("id_ is null or not maybe"), named.where("id_ is not null and maybe")
    one = some.join(found.where("kept_").select("id_"), "id_", "left_semi").groupBy("id_").agg(F.min_by("row_", "hash_").alias("row_"))
    return sure.select("row_").unionByName(one.select("row_")).select(*[F.col(f"row_.`{c}`").alias(c) for c in docs.columns])


__all__ = ["drop_near_duplicates", "near_duplicates", "super_minhash"]
