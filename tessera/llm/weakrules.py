"""Quality rules by weak supervision: rules vote or abstain, EM estimates how they vote on good and on bad
documents, and the posterior probability of good quality decides instead of all rules having to pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import private, public, stored, texts_of, with_arrow

SYMBOLS = "#*$%&|<>"
ABSTAIN, GOOD, BAD = 0, 1, 2
#: The rules in the order of a vote pattern's base-3 digits. Those that look for a defect abstain when there is none.
RULES = ("symbols", "capitals", "exclaims", "short_words", "word_length", "same_lines", "repeats", "letters", "lone_symbols", "sentences")
MEASURES = T.StructType([
    *[T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes")],
])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    hit, last = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            hit += i + 3 - max(i, last)
            last = i + 3
    return hit


def side(good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else ABSTAIN


def measure(text: str) -> tuple[int, ...]:
    """The base measures and the rules' votes as one base-3 number. No words: every rule abstains."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\v\f\r")]
    same, again = len(lines) - len(set(lines)), repeated_words(words)
    if not n:
        return 0, chars, symbols, same, again, 0
    upper = sum(map(raw.count, UPPER))
    lower = sum(map(raw.count, LOWER))
    letters = upper + lower + len(raw) - len(text)
    caps, short = upper / max(1, upper + lower), sum(len(w) <= 3 for w in words) / n
    ends = sum(x.rstrip(b" \t\v\f\r").endswith((b".", b"!", b"?", b":", b";")) for x in lines) / len(lines)
    mean, lone = chars / n, sum(w in LONE for w in words)
    votes = (
        side(False, symbols > 0.1 * n),
        side(False, caps > 0.5),
        side(False, raw.count(b"!!") > 0.1 * n),
        side(0.15 <= short <= 0.7, short < 0.05 or short > 0.85),
        side(3 <= mean <= 10, mean < 2 or mean > 15),
        side(False, same > 0.3 * len(lines)),
        side(False, again > 0.3 * n),
        side(letters > 0.85 * chars, letters < 0.7 * chars),
        side(False, lone > 0.1 * n),
        side(ends > 0.8, ends < 0.1 and len(lines) > 3),
    )
    return n, chars, symbols, same, again, sum(v * 3**i for i, v in enumerate(votes))


UPPER = [bytes([c]) for c in range(65, 91)]
LOWER = [bytes([c]) for c in range(97, 123)]
LONE = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the base measures and the vote pattern (columns of MEASURES; a null text counts as empty)."""

    def make():
        def step(batch: pa.RecordBatch) -> list:
            rows = [measure(x) for x in texts_of(batch, text)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in MEASURES]

        return step

    return with_arrow(docs, MEASURES, make, text, keep)


@dataclass
class Supervisor:
    """What EM found: the share of good documents and, for good and bad ones, how often a rule gives each vote."""

    prior: float
    given_good: np.ndarray
    given_bad: np.ndarray

    def posterior(self, votes: Column) -> Column:
        """Probability of good quality from a vote pattern; abstentions say nothing."""
        logit = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for i in range(len(RULES)):
            w = np.log(self.given_good[i] / self.given_bad[i])
            vote = F.floor(votes / F.lit(3**i)) % 3
            logit = logit + F.when(vote == GOOD, float(w[GOOD])).when(vote == BAD, float(w[BAD])).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-logit))

    def accuracy(self) -> dict[str, float]:
        """Estimated share of right votes among those each rule casts."""
        p, out = self.prior, {}
        for i, name in enumerate(RULES):
            right = p * self.given_good[i, GOOD] + (1 - p) * self.given_bad[i, BAD]
            cast = p * self.given_good[i, 1:].sum() + (1 - p) * self.given_bad[i, 1:].sum()
            out[name] = float(right / cast)
        return out


def fit(votes: DataFrame, rounds: int = 50, least: float = 20.0, pull: float = 0.05) -> Supervisor:
    """EM over all documents that have words. Only counts of vote patterns reach the driver: 3**len(RULES) rows at most.

    Each class starts from, and is drawn to by pseudo-documents (``pull`` of all, ``least`` or more), what rules are
    made for: one kind of defect each, so a good document seldom gets a bad vote, while a bad one gets a few and many
    good votes. That also fixes which class is the good one. No documents: these alone.
    """
    patterns = votes.where("n_words > 0").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    code = np.array([r["votes"] for r in patterns], dtype=np.int64)
    n = np.array([r["n"] for r in patterns], dtype=float)
    digit = np.stack([(code // 3**i) % 3 for i in range(len(RULES))], 1) if len(code) else np.zeros((0, len(RULES)), int)
    one = np.eye(3)[digit]
    strength = max(least, pull * float(n.sum()))
    start_good, start_bad = np.tile([0.18, 0.8, 0.02], (len(RULES), 1)), np.tile([0.1, 0.6, 0.3], (len(RULES), 1))
    good, bad, prior = start_good, start_bad, 0.85
    for _ in range(rounds):
        # an abstention says nothing about quality, so it has no weight
        ratio = np.log(good / bad)
        ratio[:, ABSTAIN] = 0
        logit = np.log(prior / (1 - prior)) + np.einsum("pij,ij->p", one, ratio)
        q = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        good = np.einsum("p,pij->ij", n * q, one) + strength * start_good
        bad = np.einsum("p,pij->ij", n * (1 - q), one) + strength * start_bad
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        prior = float((n @ q + 0.85 * strength) / (n.sum() + strength))
    return Supervisor(prior, good, bad)


def judged(votes: DataFrame, model: Supervisor, threshold: float = 0.5) -> DataFrame:
    """Append p_good, base_failed and kept: what is as likely good as bad, or likelier. Documents without words fail the base."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return votes.withColumns({"p_good": model.posterior(F.col("votes")), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def rule_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with measures, votes, posterior and verdict.

    Null or empty text: zero measures, base_failed, not kept. Very long texts are measured whole. Repeated rows get
    equal results each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    votes = stored(measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]), "votes")
    return judged(votes, fit(votes))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns and values, whatever their names.

    Null and empty texts fail the base rules and go; very long ones are measured whole. Repeated rows stay or go together.
    An empty table gives an empty result. The measures are taken twice rather than stored with the texts.
    """
    model = fit(measured(docs.select(text), text, []))
    own, name = private(docs, text)
    return public(judged(measured(own, name), model).where("kept"), docs.columns)
