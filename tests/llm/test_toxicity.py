"""Positive-unlabelled toxicity: the risk's slopes, the clamp, and what the fit finds."""

import math
import random

import numpy as np
import pytest

from tessera.llm.common import fold
from tessera.llm.queries import QUERIES
from tessera.llm.toxicity import Model, counted, fit, fitted, length, risk, slopes, toxicity_scores, value


def test_slopes_against_differences():
    r = np.random.default_rng(2)
    t, o, prior = r.normal(size=5), r.normal(size=9) + 1, 0.2
    for shift, negative in ((0.0, False), (-6.0, True)):
        z = o + shift
        assert (risk(t, z, prior)[1] < 0) == negative
        # above zero both parts count; below it a step goes against the second alone
        total = (lambda a, b: -risk(a, b, prior)[1]) if negative else (lambda a, b: sum(risk(a, b, prior)))
        by_t, by_o = slopes(t, z, prior)
        for x, by, make in ((t, by_t, lambda v: total(v, z)), (z, by_o, lambda v: total(t, v))):
            for i in range(len(x)):
                e = np.zeros(len(x))
                e[i] = 1e-5
                assert by[i] == pytest.approx((make(x + e) - make(x - e)) / 2e-5, abs=1e-7)


def test_fit_finds_the_mark_among_unlabelled():
    """A tenth of the unlabelled texts has the mark; those without it are hardly ever called toxic."""
    r = np.random.default_rng(4)
    make = lambda n, share: np.column_stack([(r.random(n) < share) * 3.0, r.random((n, 5)) < 0.3, np.full(n, 1.0)]).astype(np.float32)
    toxic, other = make(200, 0.95), make(1000, 0.1)
    w, b = fit(toxic, other, 0.1)
    z = lambda x: x @ w + b
    assert (z(toxic) > 0).mean() > 0.9 and (z(other) > 0).mean() < 0.12
    assert (z(other[other[:, 0] == 0]) > 0).mean() < 0.03


def test_score_against_values():
    m = Model({f: i / 10 for i, f in enumerate(counted("idiot idiots")[1])}, 0.2, -1.0)
    text = "You IDIOT, you idiots and idiotic idiot"
    n, of = counted(text)
    z = -1.0 + 0.2 * length(n) + sum(w * value(of[f], n) for f, w in m.weights.items())
    assert n == 7 and m.score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    assert m.score("") == pytest.approx(1 / (1 + math.exp(1.0)))


def corpus(spark, n=300):
    r = random.Random(8)
    calm, rude = [f"word{k}" for k in range(40)], ["blockhead", "blockheads", "nitwit"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 2
        rows.append((i, " ".join(r.choices(calm, k=r.randrange(5, 30)) + (r.choices(rude, k=2) if toxic else [])), int(toxic)))
    docs = spark.createDataFrame([(i, x, "clash") for i, x, _ in rows] + [(1000, None, None), (1001, "", "x"), (1001, "", "x"), (None, "no id", "x"), (1002, "nitwit " + "calm words " * 40_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(1, None), (77_777, 1)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_of_odd_rows(spark):
    docs, labels, want = corpus(spark)
    got = toxicity_scores(docs, fitted(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert all((by[i] >= 0.5) == bool(y) for i, y in want.items())
    assert by[1000] == by[1001] < 0.5 and [r["score"] for r in got if r["doc_id"] == 1001] == [by[1001]] * 2
    assert toxicity_scores(docs.where("false"), Model()).count() == 0


def test_toxicity_without_examples(spark):
    docs, labels, _ = corpus(spark, 20)
    m = fitted(docs, labels.where("false"))
    assert not m.weights and m.score("nitwit") == pytest.approx(0.5)
    m = fitted(docs, labels.where("toxic = 0"))
    assert not m.weights and m.score("nitwit") < 0.5
    assert fitted(docs.where("false"), labels).weights == {}


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = corpus(spark, 60)
    assert fitted(docs, labels.where(fold("doc_id", 5) == 0)).weights == {}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = QUERIES["op12_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in d}
    assert n.get((1, 0), 0) <= 1 and n[1, 1] >= 5 and n.get((0, 1), 0) <= 2
