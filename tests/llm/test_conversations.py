"""Structure repair and prefix trie against plain versions, and their SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES
from tessera.llm.repair import INK, Turn, applied, cheapest, damaged, faults, repaired
from tessera.llm.trie import chained, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?\Z")


def every_audit(initials, fault, inserts=1):
    """Cost and audit of all edit scripts with so many inserts at a place, by trying them. A turn without a role can't stay."""
    found = []
    initials = [x or "?" for x in initials]

    def go(i, said, cost, audit, put):
        if i == len(initials) and VALID.match(said):
            found.append((cost, audit))
        if put < inserts:
            for r in "ua":
                go(i, said + r, cost + 5, audit + "I", put + 1)
        if i == len(initials):
            return
        go(i + 1, said, cost + 2, audit + "D", 0)
        if fault[i] not in ("blank", "duplicate"):
            more = 5 if fault[i] == "truncated" else 0
            go(i + 1, said + initials[i], cost + more, audit + "K", 0)
            for r in "ua":
                go(i + 1, said + r, cost + 1 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_cheapest_against_all_scripts():
    for initials in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(3)):
        for fault in itertools.product(("", "blank", "truncated"), repeat=len(initials)):
            assert cheapest(list(initials), list(fault)) == every_audit(initials, fault, 2), (initials, fault)
    r = random.Random(3)
    for _ in range(25):
        n = r.choice([3, 4])
        initials = [r.choice(["s", "u", "a", "x", ""]) for _ in range(n)]
        fault = [r.choice(["", "", "duplicate", "truncated"]) for _ in range(n)]
        assert cheapest(initials, fault) == every_audit(initials, fault)


def test_long_conversation():
    n = 3000
    cost, audit = cheapest(["u", "a"] * (n // 2), [""] * n)
    assert (cost, audit) == (0, "K" * n)
    cost, audit = cheapest(["u"] * n, [""] * n)
    assert cost == n // 2 and set(audit) == {"K", "R"}


def plain_repair(rows):
    """The contract's columns for conversations in a list, damage included."""
    by = {}
    for c, t, role, text in rows:
        mine = by.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        how, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        mine += [(t, role, text)] * {0: 0, 3: 2}.get(how, 1)
    out = {}
    for c, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [Turn(*r) for r in mine]
        fault = faults(turns)
        ts = [t for t, *_ in mine if t is not None]
        cost, audit = every_audit([r[:1] for _, r, _ in mine], fault)
        said = "\n".join(f"{r}:{x}" for r, x in applied(turns, audit))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(mine)]
        out[c] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def odd_rows():
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "User", "", None]), r.choice(["Hi.", "Hi", " ", "", None, "Wie?\n", "a. b", "é…!"])) for c in range(40) for t in range(r.randrange(1, 5))]
    rows += [(7, None, "user", "Null turn."), (7, None, "user", "Null turn."), (None, 0, "user", "No id."), (50, -3, "user", "x."), (50, 4, "user", "x.")]
    return rows


def test_repair_against_plain(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*x, "kept out") for x in rows], SCHEMA + ", audit string")
    got = {d["conv_id"]: tuple(d)[1:] for d in repaired(damaged(df), with_turns=False).collect()}
    assert got == plain_repair(rows)
    whole = repaired(damaged(df)).collect()
    for d in whole:
        assert VALID.match("".join(t["role"][:1] for t in d["repaired"])), d
        assert d["repaired_sha256"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in d["repaired"]).encode()).hexdigest()
    assert repaired(damaged(df.where("false"))).count() == 0


def test_repair_loses_no_conversation(spark):
    dropped = next((c, t) for c in range(1000) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*dropped, "user", "Gone.")], SCHEMA)
    d = repaired(damaged(df), with_turns=False).first()
    assert tuple(d) == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_first_faults():
    turns = [Turn(0, "user", "Hi."), Turn(1, "user", "Hi."), Turn(2, "user", "\t\x0b"), Turn(3, "user", "\t\x0b"), Turn(4, "a", "x" * 100 + " " * 100), Turn(5, "a", "Yes! \n"), Turn(6, "a", " ")]
    assert faults(turns) == ["", "duplicate", "blank", "blank", "truncated", "", "blank"]
    assert INK.search("\u00a0")


def plain_trie(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda k: (*k[:3], hashlib.sha256(f"{len(k[2].encode())}:{k[2]}:{k[3]}".encode()).digest()))] for c, v in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, who in members.items():
        children = [k for k in members if len(k) == len(node) + 1 and k[: len(node)] == node]
        below = [k for k in members if k[: len(node)] == node]
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members) for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r) for r in prefix_trie(chained(rebuilt(df))).select(*COLUMNS).collect()), key=str)


def test_trie_against_plain(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["é", "é", "b" * 9, "", None])) for c in range(60) if c != 10 for t in range(r.randrange(1, 13))]
    rows += [(61, None, "user", "null turn"), (61, 3, "user", "b"), (61, 3, "user", "a"), (61, 3, "user", "a"), (None, 0, "user", "nobody"), (10_000, 0, "user", "é"), (2**40, 0, "user", "é")]
    df = spark.createDataFrame([(*x, b"clash") for x in rows], SCHEMA + ", keys binary")
    assert nodes_of(df) == plain_trie(rows)
    assert prefix_trie(chained(rebuilt(df.where("false")))).count() == 0


def test_trie_ends_of_many(spark):
    """Ids of several ranges end at one node; the digest goes through them in order."""
    rows = [(c * 1000, 0, "user", "same") for c in range(40)]
    got = nodes_of(spark.createDataFrame(rows, SCHEMA))
    assert got == plain_trie(rows)


@pytest.mark.parametrize("name", ["op11_structure_repair", "op13_prefix_trie"])
def test_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
