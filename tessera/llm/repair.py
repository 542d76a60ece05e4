"""Conversation structure repair: the cheapest edits that turn damaged turns into an alternating conversation.

An edit path's weight is one big integer. Its high digits are the cost; below stand as many digits as a path can have
edits, first edit first, one for each audit letter (D 1, I 2, K 3, R 4) and 0 after the last. The least integer is then the
cheapest path and, among equally cheap ones, that of the ASCII-least audit, so plain ``min`` over a DAG decides everything.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Costs of the edits, and what a truncated turn that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Digits of the audit letters in ASCII order; 0 is the padding after the last. A digit has three bits.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER, BITS = {v: k for k, v in DIGIT.items()}, 3
#: States are the last role initial of the repaired turns ("": none yet); they may end at "" and "a".
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
INK = re.compile(r"[^\x20\x09-\x0D]")
_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
REPORT = T.StructType([
    T.StructField("gaps", T.LongType()), T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()),
    T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(_TURN)),
])


@dataclass(frozen=True)
class Turn:
    turn: int | None
    role: str
    text: str


def faults(turns: list[Turn]) -> list[str]:
    """Each turn's first fault: blank, duplicate (role and text seen before), truncated (no sentence mark at its end), or none."""
    seen, out = set(), []
    for t in turns:
        ink = INK.findall(t.text[-64:]) or INK.findall(t.text)
        key = (t.role, t.text)
        out.append("blank" if not ink else "duplicate" if key in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add(key)
    return out


def cheapest(initials: list[str], fault: list[str]) -> tuple[int, str]:
    """Cost and audit of the least path, by one pass from the last turn to the first.

    From any state the rest can be deleted and at most two turns inserted, so a path of n turns has at most 2n/5 + 2 inserts:
    that many digits hold every audit that can win. Putting an edit before a path moves its digits one place down.
    """
    n = len(initials)
    low = BITS * (n + 2 * n // 5 + 4)
    mask, top = (1 << low) - 1, low - BITS

    def before(letter: str, cost: int, path: int) -> int:
        return ((path >> low) + cost << low) | DIGIT[letter] << top | (path & mask) >> BITS

    def inserted(b: dict[str, int | None]) -> dict[str, int]:
        """The best of the paths that insert no, one or two turns here; three would pass a state twice."""
        some = lambda *paths: min(p for p in paths if p is not None)
        put = lambda p: None if p is None else before("I", INSERT, p)
        u, a = some(b["u"], put(b["a"])), some(b["a"], put(b["u"]))
        return {"": some(b[""], put(u)), "s": some(b["s"], put(u)), "u": u, "a": a}

    best = inserted({"": 0, "s": None, "u": None, "a": 0})
    for initial, why in zip(reversed(initials), reversed(fault), strict=True):
        here = {}
        for state, path in best.items():
            ways = [before("D", DELETE, path)]
            if why not in ("blank", "duplicate"):
                more = TRUNCATED if why == "truncated" else 0
                ways.append(before("R", REROLE + more, best[NEXT[state]]))
                if initial == NEXT[state] or initial == "s" and not state:
                    ways.append(before("K", KEEP + more, best[initial]))
            here[state] = min(ways)
        best = inserted(here)
    path = best[""]
    digits = (path >> at & (1 << BITS) - 1 for at in range(top, -1, -BITS))
    return path >> low, "".join(LETTER[d] for d in digits if d)


def applied(turns: list[Turn], audit: str) -> list[tuple[str, str]]:
    """Role and text of the turns that the edits leave; the roles of changed and inserted ones follow from the state."""
    out, state, rest = [], "", iter(turns)
    for letter in audit:
        t = None if letter == "I" else next(rest)
        if letter == "D":
            continue
        role = t.role if letter == "K" else ROLE[NEXT[state]]
        state = role[:1]
        out.append((role, "" if t is None else t.text))
    return out


def report(turns: list[Turn]) -> tuple:
    """The columns of REPORT for one conversation in order."""
    fault, initials = faults(turns), [t.role[:1] for t in turns]
    numbers = [t.turn for t in turns if t.turn is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(initials, fault)
    return gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, [{"role": r, "text": x} for r, x in applied(turns, audit)]


def digest(turns: list[dict]) -> str:
    """SHA-256 of ``role:text`` lines."""
    return hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode("utf-8", "surrogatepass")).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's rows in order, after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its marks ``.!?`` out, 3 repeats it, 4 makes its role ``user``. Nulls in the
    key, the role and the text are one space. Rows are in order of turn, null first; rows of one turn by role and text. A
    conversation that loses all its rows stays, with no turns.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"))
    times = F.when(how == 0, 0).when(how == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.array_repeat(row, times).alias("rows")).groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("turns"))


def repaired(conversations: DataFrame, with_turns: bool = True) -> DataFrame:
    """(conv_id, REPORT columns, repaired_sha256) of conversations (conv_id, turns: array of turn, role, text in order).

    ``with_turns`` keeps the repaired turns themselves. One conversation's turns lie together in one task; the work grows
    with their square (big integers of 4.2 bits a turn). A conversation without turns has zeros, an empty audit and the
    empty string's hash; null conv_id is a conversation of its own; an empty table gives an empty result.
    """
    fields = [T.StructField("conv_id", conversations.schema["conv_id"].dataType), *(f for f in REPORT if with_turns or f.name != "repaired"), T.StructField("repaired_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(T.StructType(fields))
        for batch in batches:
            rows = []
            # one conversation at a time becomes Python objects
            for turns in batch.column("turns"):
                *said, kept = report([Turn(t["turn"], t["role"], t["text"]) for t in turns.as_py() or ()])
                rows.append([*said, *([kept] if with_turns else []), digest(kept)])
            made = zip(*rows, strict=True) if rows else [()] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), f.type) for c, f in zip(made, list(schema)[1:], strict=True))], schema=schema)

    return conversations.select("conv_id", "turns").mapInArrow(run, T.StructType(fields))


__all__ = ["REPORT", "Turn", "applied", "cheapest", "damaged", "faults", "repaired", "report"]
