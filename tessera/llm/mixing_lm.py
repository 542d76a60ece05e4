"""Language-model scores by online logistic context mixing.

A text is a sequence of words and an end. A frequent word is written as the bits of a Huffman code, any other word as the
bits of an escape and then of its bytes and their end, by a second code. Every bit is predicted by several predictors:
the tree's own weights, and two tables of counts whose slots are hashes of the tree's node with what stands before: one
or two words, and inside a word that is spelled two or four bytes. A logistic mixer combines them by weights that a gate
selects, an adaptive map refines the result, and both learn online within the document, from its first words on. The
counts come from all training documents; how many words have a code and how many slots the tables have follows from how
much there is to learn from, up to a bound of memory.

All bits are the text's code length, in bits per byte. The score is the log10 probability of the sequence of words, all
words that training never saw being one, as for the base: the bits, and for an escaped word its share of all that escapes
stand for instead of its spelling.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, steps, stored, with_arrow
from .neardup import WordHashes

#: Bounds of memory: most words with a code of their own, and slots of each table, as a power of 2, at least and at most.
WORDS, LEAST_BITS, MOST_BITS = 1 << 18, 22, 23
#: A word has a code if training saw it so often; a table has a slot for so many training tokens; slots of a block of a table.
SEEN, TOKENS_A_SLOT, BLOCK = 4, 8, 1 << 18
#: Distinct words that a task counts before it passes them on; bytes of text whose bits are laid out together.
COUNTED, LAID = 300_000, 1 << 18
#: Tokens that the mixer takes between updates: at first, then twice as many each time, up to a bound.
FIRST, MOST = 4, 1024
#: What ends the bytes of a spelled word; a word has no line feed.
STOP = 10
#: Gates and places of the refinement, for words' bits and then for spelled ones.
GATES, BOXES = 16, 37
#: The end of a text, as a word's hash. 1 and 2 stand before the first word.
END, U = np.uint64(0), np.uint64
MIX1, MIX2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
COUNT = T.StructType([T.StructField("is_byte", T.BooleanType()), T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])
TABLE = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])
SCORED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("own_known", T.LongType()), T.StructField("own_log", T.DoubleType()), T.StructField("word_log", T.DoubleType()), T.StructField("code_bits", T.DoubleType()),
    T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("row", T.LongType()),
])


@dataclass
class Words:
    """The words of some texts, lower-cased: ``data`` holds the texts, each between line feeds; a word begins at ``begin`` and has ``size`` bytes.

    ``first``: the number of each text's first word, and of all words at the end. An item is the list of a text's words.
    """

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(raws: list[bytes]) -> Words:
        # eight bytes more, so that eight can be read at any place
        data = np.frombuffer(b"\n".join([b"", *raws, b"\n" * 8]).lower(), np.uint8)
        inside = (data - np.uint8(9) > 4) & (data != 32)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin = edges[0::2]
        texts = np.cumsum([1, *(len(x) + 1 for x in raws)])
        return Words(data, begin, edges[1::2] - begin, np.searchsorted(begin, texts))

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, text: int) -> list[bytes]:
        if text >= len(self):
            raise IndexError(text)
        some = slice(self.first[text], self.first[text + 1])
        return [self.data[b : b + n].tobytes() for b, n in zip(self.begin[some].tolist(), self.size[some].tolist(), strict=True)]

    def hashes(self, known: WordHashes) -> np.ndarray:
        """The same as ``known`` has, XXH3 with 64 bits, but all words of up to 16 bytes at once.

        Constants are XXH3's own: words of its default secret, combined, and the factors of its last steps.
        """
        begin, size, end = self.begin, self.size, self.begin + self.size
        wide = lambda kind, n: np.ndarray(len(self.data) - n + 1, kind, self.data, strides=(1,))
        four, eight = wide("<u4", 4), wide("<u8", 8)
        out = np.empty(len(begin), np.uint64)
        i = np.flatnonzero(size <= 3)
        b, n = begin[i], size[i]
        x = self.data[b].astype(np.uint64) << U(16) | self.data[b + (n >> 1)].astype(np.uint64) << U(24) | self.data[b + n - 1] | n.astype(np.uint64) << U(8)
        x ^= U(0x87275A9B)
        x = (x ^ (x >> U(33))) * U(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> U(29))) * U(0x165667B19E3779F9)
        out[i] = x ^ (x >> U(32))
        i = np.flatnonzero((size > 3) & (size <= 8))
        x = four[end[i] - 4] + (four[begin[i]].astype(np.uint64) << U(32)) ^ U(0xC73AB174C5ECD5A2)
        x ^= (x << U(49) | x >> U(15)) ^ (x << U(24) | x >> U(40))
        x *= U(0x9FB21C651E98DF25)
        x = (x ^ ((x >> U(35)) + size[i].astype(np.uint64))) * U(0x9FB21C651E98DF25)
        out[i] = x ^ (x >> U(28))
        i = np.flatnonzero((size > 8) & (size <= 16))
        x, y = eight[begin[i]] ^ U(0x6782737BEA4239B9), eight[end[i] - 8] ^ U(0xAF56BC3B0996523A)
        x = size[i].astype(np.uint64) + x.byteswap() + y + (x * y ^ upper(x, y))
        x = (x ^ (x >> U(37))) * U(0x165667919E3779F9)
        out[i] = x ^ (x >> U(32))
        for k in np.flatnonzero(size > 16).tolist():
            out[k] = known[self.data[begin[k] : end[k]].tobytes()]
        return out

    def spelled(self, some: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of ``some`` words, a STOP after each; one with a size of 0 is the STOP alone."""
        ends = np.cumsum(size + 1)
        out = self.data[np.repeat(self.begin[some] - (ends - size - 1), size + 1) + np.arange(ends[-1])] if len(self.begin) else np.empty(ends[-1], np.uint8)
        out[ends - 1] = STOP
        return out


def upper(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The upper half of products with 128 bits."""
    half = U(0xFFFFFFFF)
    x0, x1, y0, y1 = x & half, x >> U(32), y & half, y >> U(32)
    mid = (x0 * y0 >> U(32)) + x1 * y0
    return x1 * y1 + (mid >> U(32)) + ((mid & half) + x0 * y1 >> U(32))


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and the sums of their counts."""
    if not len(h):
        return h, c
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], np.add.reduceat(c[order], at)


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(is_byte, h, c): how often each word, by its 64-bit hash, and each byte of a word occurs; the end counts as a word."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, known, octets, ends = to_arrow_schema(COUNT), WordHashes(), np.zeros(256, np.int64), 0
        h, c, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merge():
            nonlocal h, c
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            h, c = summed(np.append(h, new), np.append(c, n))
            waiting.clear()

        def flush():
            nonlocal h, c
            out = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), bool)), pa.array(h.view(np.int64)), pa.array(c)], schema=schema)
            h, c = h[:0], c[:0]
            return out

        for b in (s for batch in batches for s in steps(batch, text)):
            raws = bytes_of(b, text)
            ends += len(raws)
            for x, y in parts(raws):
                words = Words.of(raws[x:y])
                octets += np.bincount(words.data, minlength=256)
                waiting.append(words.hashes(known))
            if sum(map(len, waiting)) > COUNTED:
                merge()
            if len(h) > COUNTED:
                yield flush()
        if ends:
            if waiting:
                merge()
            yield flush()
            yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([int(END)]), pa.array([ends])], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(256, bool)), pa.array(np.arange(256)), pa.array(octets)], schema=schema)

    return docs.select(text).mapInArrow(run, COUNT).groupBy("is_byte", "h").agg(F.sum("c").alias("c"))


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the symbols' paths; the inner nodes and bits of all paths, end to end; each inner node's share of weight on its 1 side."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side, ones = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), np.zeros(n - 1)
    for k in range(n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = n + k
        side[b[1]] = 1
        ones[k] = b[0] / (a[0] + b[0])
        heapq.heappush(heap, (a[0] + b[0], n + k))
    at, top, nodes, bits = np.arange(n), 2 * n - 2, [], []
    while (at != top).any():
        up = at != top
        nodes.append(np.where(up, parent[at] - n, -1).astype(np.int32))
        bits.append(side[at].astype(np.int8))
        at = np.where(up, parent[at], at)
    node, bit = np.stack(nodes[::-1], 1), np.stack(bits[::-1], 1)
    real = node >= 0
    return real.sum(1), node[real], bit[real], ones


def stretched(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-7, 1 - 1e-7)
    return np.log(share / (1 - share)).astype(np.float32)


@dataclass
class Code:
    """The frequent words (sorted hashes, their symbols and counts) and the paths of all symbols, end to end.

    Symbols: words, then the escape, then the 256 bytes of spelled words. ``key`` is a path place's node, scrambled, with
    its bit lowest; ``own`` the stretched probability of the node's 1 side. ``bits``: slots of a table, as a power of 2.
    ``near``: where hashes with the same upper bits begin.
    """

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    key: np.ndarray
    own: np.ndarray
    bits: int
    near: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, rest: float, octets: np.ndarray, bits: int = LEAST_BITS) -> Code:
        """``rest``: how often other words occur; ``octets``: counts of bytes in words."""
        one = (np.array([1]), np.array([0]), np.array([0]), np.array([1e-7]))
        length, inner, bit, ones = huffman(np.append(counts + 1.0, max(1.0, rest))) if len(hashes) else one
        weight = octets + 1.0
        weight[STOP] = octets.sum() / 8 + 1.0
        length2, inner2, bit2, ones2 = huffman(weight)
        length, bit = np.append(length, length2), np.append(bit, bit2)
        own = np.append(stretched(ones)[inner], stretched(ones2)[inner2])
        node = np.append(inner, inner2 + len(ones)).astype(np.uint32) * MIX2
        key = (node ^ (node >> np.uint32(15))) & np.uint32(0xFFFFFFFE) | bit.astype(np.uint32)
        order = np.argsort(hashes)
        upper_bits = max(1, len(hashes).bit_length())
        near = np.searchsorted(hashes[order], np.arange(1 << upper_bits).astype(np.uint64) << U(64 - upper_bits)).astype(np.int32)
        return Code(hashes[order], order.astype(np.int32), counts[order].astype(np.int64), (np.cumsum(length) - length).astype(np.int32), length.astype(np.int32), key, own, bits, near)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes``, and which of ``h`` stand there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        last, shift = len(self.hashes) - 1, U(65 - len(self.near).bit_length())
        at = np.minimum(self.near.take((h >> shift).astype(np.int64)), last).astype(np.int64)
        # hashes are spread evenly, so only few steps lead to the first that isn't less
        behind = np.flatnonzero(self.hashes.take(at) < h)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[self.hashes.take(at[behind]) < h[behind]]
        np.minimum(at, last, out=at)
        return at, self.hashes.take(at) == h


@dataclass
class Laid:
    """The bits of some texts in the order of the mixer's updates: first the first tokens of all texts, and so on.

    ``path``: each bit's place in the code's paths; ``key``: that place's; ``slot1``, ``slot2``: its table slots; ``half``:
    twice its text, by rank, the longest first, and one more if it spells a word. ``ends``: where each update's bits end;
    ``live``: how many texts have bits in it, and in a later one; ``rank``: of each text; ``at``: of each token, its word's
    place in the code, or -1.
    """

    path: np.ndarray
    key: np.ndarray
    slot1: np.ndarray
    slot2: np.ndarray
    half: np.ndarray
    ends: list
    live: list
    rank: np.ndarray
    at: np.ndarray


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * MIX1
    return x ^ (x >> np.uint32(13))


def halves(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))).astype(np.uint32)


def updates(longest: int) -> np.ndarray:
    """Token numbers at which the mixer has learned from all before."""
    out, step = [0], FIRST
    while out[-1] < longest:
        out.append(out[-1] + step)
        step = min(MOST, 2 * step)
    return np.array(out)


def byte_contexts(data: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the two and of the four bytes before each byte, inside its word (``within``: its place there)."""
    before = np.zeros((4, len(data)), np.uint32)
    for k in range(4):
        before[k, k + 1 :] = data[: len(data) - k - 1]
        before[k, within <= k] = 0
    c1 = scrambled((before[0] | before[1] << np.uint32(8) | np.uint32(1 << 24)) * MIX2)
    return c1, scrambled(c1 * MIX2 + (before[2] | before[3] << np.uint32(8) | np.uint32(1 << 25)))


def symbols(code: Code, words: Words, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and both contexts of all tokens, then of the bytes of escaped ones; each token's place in the code, or -1; escaped tokens and how many bytes each has."""
    h = np.concatenate(hashes)
    count = np.array([len(x) for x in hashes])
    first = np.cumsum(count) - count
    at, hit = code.find(h)
    escape = len(code.hashes)
    symbol = np.where(hit, code.symbols[at], escape).astype(np.int32) if escape else np.zeros(len(h), np.int32)
    # what stands before a word: marks at a text's beginning
    before1, before2 = np.empty_like(h), np.empty_like(h)
    before1[1:], before2[2:] = h[:-1], h[:-2]
    before1[first] = 1
    before2[first] = before2[np.minimum(first + 1, first + count - 1)] = 2
    c1 = scrambled(halves(before1))
    c2 = scrambled(c1 * MIX2 + halves(before2))
    missed, size = np.flatnonzero(~hit), np.zeros(0, np.int64)
    if len(missed):
        # a text's end has no word; where it escapes, it takes the place of any word and has no bytes
        text = np.searchsorted(first, missed, "right") - 1
        place = missed - first[text]
        some, real = words.first[text] + place, place < np.diff(words.first)[text]
        some = np.where(real, some, 0)
        size = np.where(real, words.size[some], 0) + 1 if len(words.size) else np.ones(len(missed), np.int64)
        data = words.spelled(some, size - 1)
        b1, b2 = byte_contexts(data, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size))
        symbol = np.append(symbol, escape + 1 + data.astype(np.int32))
        c1, c2 = np.append(c1, b1), np.append(c2, b2)
    return symbol, c1, c2, np.where(hit, at, -1), missed, size


def bits_of(code: Code, symbol: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many bits each symbol has; of all bits the place in the paths, its key, and the slots in both tables."""
    bits = code.length[symbol]
    path = np.repeat(code.begin[symbol] - (np.cumsum(bits) - bits), bits)
    path += np.arange(len(path))
    key = code.key.take(path, mode="clip")
    node, shift = key >> np.uint32(1), np.uint32(32 - code.bits)
    slot1, slot2 = np.repeat(c1, bits), np.repeat(c2, bits)
    slot1 += node
    slot1 *= MIX1
    slot1 >>= shift
    slot2 ^= node
    slot2 *= MIX2
    slot2 >>= shift
    return bits, path, key, slot1, slot2


def lay(code: Code, words: Words | list[list[bytes]], hashes: list[np.ndarray]) -> Laid:
    """The bits of texts, given their words and the words' hashes, with END after each text's."""
    words = words if isinstance(words, Words) else Words.of([b" ".join(x) for x in words])
    count = np.array([len(x) for x in hashes])
    symbol, c1, c2, at, missed, size = symbols(code, words, hashes)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    cuts = updates(int(count.max()))
    group = (np.searchsorted(cuts, np.arange(count.max()), "right") - 1)[place] * len(count) + np.repeat(rank, count)
    group = np.append(group, np.repeat(group[missed], size))
    # by group, and in it as they come: a sort of both in one number is several times faster than a stable one
    group = np.sort(group << 32 | np.arange(len(group)))
    order = group & 0xFFFFFFFF
    group >>= 32
    bits, path, key, slot1, slot2 = bits_of(code, symbol[order], c1[order], c2[order])
    last = np.searchsorted(group, np.arange(1, len(cuts)) * len(count)) - 1
    half = group % len(count) * 2 + (order >= len(at))
    return Laid(path, key, slot1, slot2, np.repeat(half, bits), np.cumsum(bits)[last].tolist(), [(int((count > a).sum()), int((count > b).sum())) for a, b in zip(cuts, cuts[1:], strict=False)], rank, at)


def hashed(raws: list[bytes], known: WordHashes) -> tuple[Words, list[np.ndarray]]:
    """The words of texts and each text's hashes, with END after them."""
    words = Words.of(raws)
    h = np.insert(words.hashes(known), words.first[1:], END)
    return words, np.split(h, words.first[1:-1] + np.arange(1, len(raws)))


def parts(raws: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about LAID bytes."""
    out, a, n = [], 0, 0
    for i, x in enumerate(raws):
        n += len(x)
        if n >= LAID:
            out.append((a, i + 1))
            a, n = i + 1, 0
    return [*out, (a, len(raws))] if a < len(raws) else out


class Shared:
    """A broadcast, sent compressed, that each worker unpacks once; its size is bounded by WORDS and MOST_BITS."""

    #: The latest that this process has unpacked, by name.
    unpacked: dict = {}

    def __init__(self, df: DataFrame, value):
        import zstandard

        self.name, self.held = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(zstandard.compress(pickle.dumps(value, 5), 3))

    @property
    def value(self):
        import zstandard

        if self.name not in Shared.unpacked:
            if len(Shared.unpacked) > 1:
                Shared.unpacked.clear()
            Shared.unpacked[self.name] = pickle.loads(zstandard.decompress(self.held.value))
        return Shared.unpacked[self.name]


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of two widths, compressed."""
    import zstandard

    wide = counts.max(initial=0) > 255
    return (b"8" if wide else b"1") + zstandard.compress(counts.astype(np.uint64 if wide else np.uint8).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[1:]), np.uint64 if data[:1] == b"8" else np.uint8)


def context_tables(docs: DataFrame, held: Shared, bits: int, text: str = "text") -> DataFrame:
    """(block, part, counts): the two tables' predictions, from how often each slot was followed by 0 and by 1 in all documents.

    A task counts into its own tables and passes on the blocks that it touched. Those of one number meet in two steps,
    by parts of about as many tasks as there are parts and then all, in a task for each block that holds a single sum.
    """
    parts_ = max(1, math.isqrt(docs.rdd.getNumPartitions()))

    def count(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, known, part = to_arrow_schema(TABLE), WordHashes(), TaskContext.get().partitionId() % parts_
        tables, code = [], held.value
        for b in (s for batch in batches for s in steps(batch, text)):
            raws = bytes_of(b, text)
            tables = tables or [np.zeros(2 << code.bits, np.uint32) for _ in range(2)]
            for x, y in parts(raws):
                _, _, key, *slots = bits_of(code, *symbols(code, *hashed(raws[x:y], known))[:3])
                key &= np.uint32(1)
                for table, slot in zip(tables, slots, strict=True):
                    slot *= np.uint32(2)
                    slot += key
                    np.add.at(table, slot, np.uint32(1))
        for i, table in enumerate(tables):
            for k, piece in enumerate(table.reshape(-1, 2 * BLOCK)):
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i * len(table) // (2 * BLOCK) + k], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(piece)])], schema=schema)

    def add(last: bool):
        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            schema, at, total = to_arrow_schema(TABLE), None, None
            out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([predictions(total) if last else packed(total)])], schema=schema)
            for batch in batches:
                for r in range(batch.num_rows):
                    now, data = (batch.column(0)[r].as_py(), 0 if last else batch.column(1)[r].as_py()), unpacked(batch.column(2)[r].as_py())
                    if now == at:
                        total += data
                    else:
                        if total is not None:
                            yield out()
                        at, total = now, data.astype(np.uint64)
            if total is not None:
                yield out()

        return run

    blocks = (2 << bits) // BLOCK
    some = docs.select(text).mapInArrow(count, TABLE).repartition(blocks, "block", "part").sortWithinPartitions("block", "part").mapInArrow(add(False), TABLE)
    return some.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(add(True), TABLE)


def predictions(counts: np.ndarray) -> bytes:
    """Each slot as one small number: the stretched probability of 1 in 64ths, and in the lowest two bits how sure it is."""
    n = counts.reshape(-1, 2).astype(np.float64)
    total = n.sum(1)
    stretch = np.round(64 * np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))).clip(-640, 640).astype(np.int16)
    return (stretch * 4 + ((total > 0).astype(np.int16) + (total > 3) + (total > 20))).astype("<i2").tobytes()


def tables_of(rows: list, bits: int) -> list[np.ndarray]:
    flat = np.zeros(2 << bits, np.int16)
    for r in rows:
        flat[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i2")
    return [flat[: 1 << bits], flat[1 << bits :]]


def first_weights() -> np.ndarray:
    """(3, 2 * GATES): weights of each predictor by gate: how sure the two tables are; words' bits, then spelled ones."""
    w = np.zeros((4, 4, 3), np.float32)
    w[0, :] = 1, 0, 0
    w[1, :] = 0.85, 0.2, 0
    w[2, :] = 0.6, 0.45, 0
    w[3, :] = 0.2, 0.85, 0
    w[:, 1] = 0.6, 0.25, 0.15
    w[:, 2] = 0.3, 0.4, 0.35
    w[:, 3] = 0.1, 0.3, 0.65
    return np.tile(w.reshape(GATES, 3).T, 2)


def log_more(x: np.ndarray) -> np.ndarray:
    """log(1 + x): the rounding of the sum is given back, so it is as exact as log1p, which is several times slower for float32."""
    more = 1 + x
    return np.log(more) + (x - (more - 1)) / more


class Mixer:
    """Scores the bits of many texts side by side, each by its own weights; every text starts from the same ones."""

    def __init__(self, code: Code, tables: list[np.ndarray], rate: float = 0.02, refine: float = 0.02):
        self.code, self.tables, self.rate, self.refine = code, tables, rate, refine
        self.start = first_weights()

    def logs(self, laid: Laid) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each text's words (escapes as such), and of the spelling of its escaped words."""
        n = len(laid.rank)
        w = [np.tile(x, n) for x in self.start]
        fine, total = np.zeros(n * 2 * BOXES, np.float32), np.zeros(2 * n)
        a = 0
        for b, (live, later) in zip(laid.ends, laid.live, strict=True):
            # all places are inside their arrays: "clip" only spares the check
            v1, v2 = self.tables[0].take(laid.slot1[a:b], mode="clip"), self.tables[1].take(laid.slot2[a:b], mode="clip")
            half = laid.half[a:b]
            g = half * GATES
            g += ((v1 & 3) << 2) | (v2 & 3)
            sign = (laid.key[a:b] & np.uint32(1)).astype(np.float32) * 2 - 1
            xs = self.code.own.take(laid.path[a:b], mode="clip"), (v1 >> 2) * np.float32(1 / 64), (v2 >> 2) * np.float32(1 / 64)
            st = w[0].take(g, mode="clip") * xs[0]
            st += w[1].take(g, mode="clip") * xs[1]
            st += w[2].take(g, mode="clip") * xs[2]
            np.clip(st, -9, 9, out=st)
            box = (st * 2 + 18.5).astype(np.int64)
            box += half * BOXES
            st += fine.take(box, mode="clip")
            st *= sign
            odds = np.exp(-st)
            total[: 2 * live] -= np.bincount(half, log_more(odds), 2 * live)
            if later:
                # the longest texts come first, so those that go on are the first ones
                miss = odds / (1 + odds)
                miss *= sign
                for weight, x in zip(w, xs, strict=True):
                    weight[: 2 * GATES * live] += np.clip(self.rate * np.bincount(g, miss * x, 2 * GATES * live), -0.2, 0.2)
                fine[: 2 * BOXES * live] += np.clip(self.refine * np.bincount(box, miss, 2 * BOXES * live), -0.2, 0.2)
            a = b
        return total[0::2][laid.rank], total[1::2][laid.rank]


@dataclass
class Model:
    """What was learned: the token counts (h, c), their sums, what escapes stand for, the code and the tables."""

    counts: DataFrame
    tokens: int
    kinds: int
    escaped: float
    code: Code
    held: Shared
    tables: list[np.ndarray]


def learn(train: DataFrame, text: str = "text") -> Model:
    """Learn from all texts of ``train``.

    All words that occur SEEN times or more have a code, the WORDS most frequent ones if there are more, and the tables a
    slot for TOKENS_A_SLOT tokens, between 2**LEAST_BITS and 2**MOST_BITS: so much is sent to the driver and broadcast,
    about 80 MB at most. The counts of all words stay a table.
    """
    every = stored(token_counts(train, text), "token-counts")
    counts = every.where("not is_byte").select("h", "c")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    octets = np.zeros(256)
    for r in every.where("is_byte").collect():
        octets[r["h"]] = r["c"]
    octets[[9, 10, 11, 12, 13, 32]] = 0
    top = counts.where(F.col("c") >= SEEN).orderBy(F.desc("c"), "h").limit(WORDS).toArrow()
    hashes, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.float64)
    if n and not (hashes == END).any():
        ends = counts.where(F.col("h") == int(END)).first()
        hashes, c = np.append(hashes, END), np.append(c, float(ends["c"]) if ends else 0.0)
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(n / TOKENS_A_SLOT)))) if n else LEAST_BITS
    code = Code.of(hashes, c, n - c.sum(), octets, bits)
    held = Shared(train, code)
    tables = tables_of(context_tables(train, held, bits, text).collect(), bits)
    return Model(counts, n, v, n - c.sum() + v - int((c > 0).sum()) + 1, code, held, tables)


def scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, n_known, base_score, score (log10 probabilities) and bits_per_byte to each row of ``docs``.

    Null and empty texts are the end alone. Texts are scored whole, each by itself, so equal texts score alike. With
    nothing learned, all words are spelled. Columns named like a new one are replaced; an empty table gives an empty result.
    """
    from pyspark import TaskContext

    held, code = Shared(docs, model.tables), model.held

    def make():
        known, mixer, seen = WordHashes(), Mixer(code.value, held.value), [0]
        log = np.log10(code.value.counts + 1.0)

        def step(batch: pa.RecordBatch) -> list:
            raws = bytes_of(batch, text)
            cols: list[list] = [[] for _ in SCORED]
            for x, y in parts(raws):
                words, hashes = hashed(raws[x:y], known)
                laid = lay(code.value, words, hashes)
                said, written = mixer.logs(laid)
                n, h = np.array([len(v) for v in hashes]), np.concatenate(hashes)
                text_of, hit = np.repeat(np.arange(len(n)), n), laid.at >= 0
                own, where = laid.at[hit], text_of[hit]
                seen[0] += len(n)
                row = (
                    n, [len(v) for v in raws[x:y]], np.bincount(where[code.value.counts[own] > 0], minlength=len(n)), np.bincount(where, log[own], len(n)), said / np.log(10), -(said + written) / np.log(2),
                    pa.ListArray.from_arrays(np.append(0, np.cumsum(n - np.bincount(where, minlength=len(n)))).astype(np.int32), h[~hit].view(np.int64)),
                    (TaskContext.get().partitionId() << 36) + seen[0] - np.arange(len(n)),
                )
                for c, value in zip(cols, row, strict=True):
                    c.append(pa.array(value) if not isinstance(value, pa.Array) else value)
            return [pa.concat_arrays(c) for c in cols]

        return step

    s = stored(with_arrow(docs, SCORED, make, text, keep), "scored")
    rare = s.select("row", F.explode("rare").alias("h")).join(model.counts, "h")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("rare_log"))
    size, escaped = F.lit(float(np.log10(model.tokens + model.kinds + 1))), F.lit(float(np.log10(model.escaped)))
    none: Column = F.lit(0)
    out = s.withColumn("n_rare", F.size("rare")).drop("rare").join(rare, "row", "left").withColumns({
        "n_known": (F.col("own_known") + F.coalesce("rare_known", none)).cast("long"),
        "base_score": F.col("own_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * size,
        "train_tokens": F.lit(model.tokens).cast("long"),
        "score": F.col("word_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_rare") * escaped,
        "bits_per_byte": F.when(F.col("n_bytes") > 0, F.col("code_bits") / F.col("n_bytes")),
    })
    return out.drop("own_known", "own_log", "word_log", "code_bits", "rare_known", "rare_log", "n_rare", "row")
