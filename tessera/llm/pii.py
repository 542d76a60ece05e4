"""Personal data: patterns and a skip-chain conditional random field over a document's number- and address-like tokens.

Pattern spans are evidence and stay. Neighbouring tokens share chain potentials; repeated or similar tokens anywhere in
the document, and numbers written in several tokens, share skip potentials; loopy message passing makes their labels agree, which finds occurrences that a
pattern misses.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import private, public, texts_of, window_of, with_arrow

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1
#: Bound of the documents that the potentials are fitted on, and of the characters of each, from a place by its hash on.
FIT_DOCUMENTS, FIT_CHARS = 2000, 20_000
#: Rounds of message passing, their damping, and the belief from which a token is taken.
ROUNDS, DAMPING, SURE = 8, 0.3, 0.8
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that doesn't begin a match doesn't hold one further on, so scanning starts at its first digit only
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WHITE = frozenset(" \t\n\v\f\r")
HIT = re.compile(r"[0-9@]")
NOT_DIGIT, BETWEEN = re.compile(r"[^0-9]"), re.compile(r"[ ()]")
#: A token that may be part of a number written in several tokens, and what may stand between two of them.
GROUP, GAP = re.compile(r"\+?[0-9().-]*[0-9][0-9().-]*"), re.compile(r"\)? ?[(-]? ?")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches by their @: what stands before it is the longest run of local characters after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern spans, by start and kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, without punctuation at their ends; words are runs without ASCII white space."""
    out, end, n = [], 0, len(text)
    m = HIT.search(text)
    while m:
        a = m.start()
        while a > end and text[a - 1] not in WHITE:
            a -= 1
        b = m.end()
        while b < n and text[b] not in WHITE:
            b += 1
        end = b
        while b > a and text[b - 1] in ".,;:!?)]}>\"'|#$%&*":
            b -= 1
        while a < b and text[a] in "([{<\"'|#$%&*":
            a += 1
        out.append((a, b))
        m = HIT.search(text, end)
    return out


FEATURES = 24


def shape(word: str, gap: bool) -> list[int]:
    """Which of FEATURES features a token has; they describe its form, not its place."""
    d = NOT_DIGIT.sub("", word)
    n = len(d)
    out = [0, 1 + min(n, 9) if n < 10 else 11 if n < 12 else 12 if n <= 15 else 13 if n <= 19 else 14]
    if "@" in word:
        out.append(15)
        if DOMAIN.search(word):
            out.append(16)
    if word.count(".") == 3 and n + 3 == len(word):
        out.append(17)
    if n == len(word):
        out.append(18)
    if word[:1] == "+":
        out.append(19)
    if "-" in word:
        out.append(20)
    if n >= 12 and n == len(word) and luhn(d):
        out.append(21)
    if n < len(word) / 2:
        out.append(22)
    if gap:
        out.append(23)
    return out


def same_key(word: str) -> str | None:
    """Tokens with the same key are linked: the digits of long numbers however they are written, or the lower-case word."""
    d = NOT_DIGIT.sub("", word)
    if len(d) >= 7 and "@" not in word:
        return d
    return word.lower() if "@" in word or word.count(".") == 3 else None


def suffixes(digits: str) -> list[str]:
    """What is left of a number of a telephone's length without its first one to three digits, its country code perhaps."""
    return [digits[k:] for k in range(1, 4) if len(digits) - k >= 7] if len(digits) <= 15 else []


def joined_numbers(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(first token, last token, digits) of the numbers written in several tokens that are repeated elsewhere in the text.

    Digit groups that a space, brackets or a hyphen part are one run; any part of a run with 7 to 19 digits may be a
    number. One counts if the same digits, or the same but for a country code, stand apart from it. Of those that overlap,
    one with an equal stands before one with a similar, then the longer before the shorter.
    """
    words = [text[a:b] for a, b in spans]
    digits = [NOT_DIGIT.sub("", w) if GROUP.fullmatch(w) else "" for w in words]
    many, every = [], []
    for i, w in enumerate(words):
        d = digits[i]
        if not d:
            if (key := same_key(w)) is not None and "@" not in w and key.isdigit():
                every.append((i, i, key))
            continue
        if 7 <= len(d):
            every.append((i, i, d))
        j = i + 1
        while j < len(words) and digits[j] and words[j][0] != "+" and GAP.fullmatch(text, spans[j - 1][1], spans[j][0]):
            d += digits[j]
            if len(d) > 19:
                break
            if len(d) >= 7:
                many.append((i, j, d))
            j += 1
    if not many:
        return []
    # where the first one of some digits ends and the last one begins, and the same for what similar ones end with
    own, ends = {}, {}
    for i, j, d in many + every:
        for held, names in ((own, (d,)), (ends, suffixes(d))):
            for name in names:
                lo, hi = held.get(name, (j, i))
                held[name] = min(lo, j), max(hi, i)
    apart = lambda held, name, i, j: name in held and (held[name][0] < i or held[name][1] > j)
    found = []
    for i, j, d in many:
        if apart(own, d, i, j):
            found.append((0, -len(d), i, j, d))
        elif len(d) <= 15 and (apart(ends, d, i, j) or any(apart(own, x, i, j) for x in suffixes(d))):
            found.append((1, -len(d), i, j, d))
    out, taken = [], set()
    for _, _, i, j, d in sorted(found):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((i, j, d))
    return sorted(out)


@dataclass
class Graph:
    """Tokens of a document, then repeated numbers of several tokens, with their features, labels known from patterns (-1: unknown), edges (i, j, is_skip), which have a key, and whether it is a number."""

    spans: list
    on: np.ndarray
    known: np.ndarray
    edges: np.ndarray
    keyed: np.ndarray
    bare: np.ndarray


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    spans = tokens(text)
    if not spans:
        return None
    on, known = np.zeros((len(spans), FEATURES), np.float32), np.full(len(spans), -1)
    edges, keys, at = [], [], 0
    order = sorted(base)
    for i, (a, b) in enumerate(spans):
        word = text[a:b]
        near = i > 0 and a - spans[i - 1][1] <= 1
        on[i, shape(word, near)] = 1
        while at < len(order) and order[at][1] <= a:
            at += 1
        k = at
        while k < len(order) and order[k][0] < b:
            if order[k][1] > a:
                known[i] = order[k][2]
                break
            k += 1
        if near:
            edges.append((i - 1, i, 0))
        key = same_key(word)
        if key is not None:
            keys.append((a, i, key))
    many = joined_numbers(text, spans)
    if many:
        n = len(spans)
        on = np.concatenate([on, np.zeros((len(many), FEATURES), np.float32)])
        known = np.concatenate([known, np.full(len(many), -1)])
        begins = [s[0] for s in order]
        for k, (i, j, d) in enumerate(many, n):
            a, b = spans[i][0], spans[j][1]
            while a > 0 and text[a - 1] in "+(":
                a -= 1
            on[k, shape(BETWEEN.sub("", text[a:b]), False)] = 1
            # the pattern spans that hold its first digit: it is known where one holds all of it
            at = bisect_right(begins, spans[i][0])
            known[k] = next((c for x, y, c in reversed(order[max(0, at - 8) : at]) if x <= spans[i][0] and b <= y), -1)
            spans.append((a, b))
            keys.append((a, k, d))
    last, ends, halves = {}, {}, {}
    for _, i, key in sorted(keys):
        near = suffixes(key) if key.isdigit() else []
        links = {last.get(key), ends.get(key) if len(key) <= 15 else None, *map(last.get, near)} - {None}
        # similar ones: the same mailbox at another domain, or a number with one digit changed, so that a half is the same
        n, half = len(key), len(key) // 2
        parts = [(n, 0, key[:half]), (n, 1, key[half:])] if key.isdigit() and n >= 10 else [key[: key.index("@") + 1]] if key.find("@") > 2 else []
        for part in parts:
            j, other = halves.get(part, (None, ""))
            if j is not None and (isinstance(part, str) or close(other, key)):
                links.add(j)
            halves[part] = i, key
        for j in links:
            if spans[j][1] <= spans[i][0]:
                edges.append((j, i, 1))
        last[key] = i
        for x in near:
            ends[x] = i
    bare = np.zeros(len(spans), bool)
    bare[[i for _, i, key in keys if key.isdigit() and not on[i, 17]]] = True
    return Graph(spans, on, known, np.array(edges, np.int64).reshape(-1, 3), np.array([k[1] for k in keys], np.int64), bare)


@dataclass
class Potentials:
    """unary: features x labels; pair: chain and skip label pairs."""

    unary: np.ndarray
    pair: np.ndarray


def fit(texts: list[str], rounds: int = 150, rate: float = 0.1) -> Potentials:
    """Pseudo-likelihood of the pattern labels, with each token's neighbours given, by Adam. No tokens: no preferences.

    A third of the tokens that patterns mark keep only the form features that any writing of the same value has, so
    that links, not just forms, carry weight. What is linked to a marked token but isn't marked has no label: a pattern
    that misses another writing doesn't say that it is something else.
    """
    graphs = [g for x in texts if (g := graph(x, patterns(x)))]
    unary, pair = np.zeros((FEATURES, LABELS)), np.zeros((2, LABELS, LABELS))
    pair[1] += 1.5 * np.eye(LABELS)
    if not graphs:
        return Potentials(unary, pair)
    shift = np.cumsum([0, *(len(g.spans) for g in graphs)])
    on = np.concatenate([g.on for g in graphs]).astype(np.float64)
    y = np.concatenate([np.where(g.known < 0, OTHER, g.known) for g in graphs])
    edges = np.concatenate([g.edges + [s, s, 0] for g, s in zip(graphs, shift, strict=False)])
    third = np.arange(len(y)) % 3 == 0
    on = np.where(third[:, None] & np.isin(np.arange(FEATURES), [16, 17, 19, 21]), 0, on)
    # a long number's third is written in digits alone
    bare = np.flatnonzero(third & (y != OTHER) & np.concatenate([g.bare for g in graphs]))
    on[np.ix_(bare, [18, 20, 22])] = 1, 0, 0
    around = np.zeros((len(y), 2, LABELS))
    for i, j in ((0, 1), (1, 0)):
        np.add.at(around, (edges[:, i], edges[:, 2], y[edges[:, j]]), 1)
    x = np.concatenate([on, around.reshape(len(y), -1)], 1)
    w = np.concatenate([unary, pair.reshape(-1, LABELS)])
    target = np.eye(LABELS)[y]
    a, b = edges[edges[:, 2] == 1, :2].T
    labelled = np.ones(len(y), bool)
    labelled[a[(y[a] == OTHER) & (y[b] != OTHER)]] = labelled[b[(y[b] == OTHER) & (y[a] != OTHER)]] = False
    x, target = x[labelled], target[labelled]
    m, v, prior = np.zeros_like(w), np.zeros_like(w), w.copy()
    for t in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - target) / len(x) + 1e-3 * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    pair = w[FEATURES:].reshape(2, LABELS, LABELS)
    return Potentials(w[:FEATURES], (pair + pair.transpose(0, 2, 1)) / 2)


def beliefs(g: Graph, p: Potentials) -> np.ndarray:
    """Label beliefs of the tokens by loopy sum-product message passing; tokens in pattern spans are observed."""
    local = g.on @ p.unary
    seen = g.known >= 0
    local[seen] = -30.0
    local[seen, g.known[seen]] = 0.0
    local -= local.max(1, keepdims=True)
    if not len(g.edges):
        e = np.exp(local)
        return e / e.sum(1, keepdims=True)
    a, b, kind = g.edges.T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    table = np.exp(p.pair)[np.concatenate([kind, kind])]
    n, back = len(a), np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((2 * n, LABELS))
    for _ in range(ROUNDS):
        total = local.copy()
        np.add.at(total, dst, message)
        out = total[src] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, table) + 1e-300)
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    total = local
    np.add.at(total, dst, message)
    e = np.exp(total - total.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def find(text: str, p: Potentials) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pattern spans, and the spans that the field adds: long numbers and addresses that it is sure of."""
    base = patterns(text)
    g = graph(text, base)
    if g is None or not (g.known[g.keyed] < 0).any():
        return base, []
    belief = beliefs(g, p)
    added, end = [], 0
    for i in sorted(g.keyed.tolist(), key=lambda i: (g.spans[i][0], -g.spans[i][1])):
        k = int(belief[i].argmax())
        if g.known[i] < 0 and k != OTHER and belief[i, k] >= SURE and g.spans[i][1] > end:
            end = g.spans[i][1]
            added.append((*g.spans[i], k))
    return base, added


def close(a: str, b: str) -> bool:
    """Whether numbers of the same length differ in one digit."""
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("pattern", T.BooleanType())])
FOUND = T.StructType([T.StructField("pii", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first span in angle brackets."""
    out, end = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if spans else text


def fitted(docs: DataFrame, text: str = "text") -> Potentials:
    """Potentials from the FIT_DOCUMENTS distinct texts of the smallest hashes among those with a digit or an @.

    Of a longer text, FIT_CHARS characters count from a place that its hash gives, anywhere in it.
    """
    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    last = some.select("h").distinct().orderBy("h").limit(FIT_DOCUMENTS).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    rows = some.where(F.col("h") <= last).groupBy("h").agg(F.min(window_of(F.col("t"), F.col("h"), FIT_CHARS)).alias("t"))
    return fit([r["t"] for r in rows.orderBy("h").collect()])


def personal_data(docs: DataFrame, p: Potentials, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``pii`` (spans in code points, end exclusive) and ``redacted``, the text with them replaced.

    Null texts: no spans, redacted stays null; empty texts: no spans. Whole texts are read, however long. Repeated rows
    get equal results; columns named like a new one are replaced; an empty table gives an empty result.
    """

    def make():
        def step(batch: pa.RecordBatch) -> list:
            pii, red = [], []
            for x, null in zip(texts_of(batch, text), batch.column(text).is_null().to_pylist(), strict=True):
                base, added = find(x, p)
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (s[0], s[2], s[1]))
                pii.append([{"kind": KINDS[k], "start": a, "end": b, "pattern": own} for a, b, k, own in every])
                red.append(None if null else redact(x, base + added))
            return [pii, red]

        return step

    return with_arrow(docs, FOUND, make, text, keep)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``, and ``n_chars``, where there is one, counted again.

    All rows and columns stay, whatever their names. Null texts stay null and keep their ``n_chars``; empty ones stay
    empty; very long ones are read whole. Repeated rows get equal results. An empty table gives an empty result.
    """
    own, name = private(docs)
    out = personal_data(own, fitted(docs), name).withColumn(name, F.col("redacted"))
    if "n_chars" in docs.columns:
        chars = f"own_{docs.columns.index('n_chars')}__"
        out = out.withColumn(chars, F.coalesce(F.length(name).cast(docs.schema["n_chars"].dataType), F.col(chars)))
    return public(out, docs.columns)
