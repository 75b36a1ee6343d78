import numpy as np
import pytest
from pyspark.sql import functions as F

from commitloom.llm import consensus as C


def crowd(seed=1, n=600, skills=(0.95, 0.85, 0.8, 0.6), share=0.65):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < share
    rows = []
    for a, p in enumerate(skills):
        for i in np.flatnonzero(rng.random(n) < 0.7):
            right = rng.random() < p
            rows.append((f"i{i}", f"a{a}", "yes" if truth[i] == right else "no"))
    return truth, rows


def em(rows, rounds=200):
    """One-coin Dawid-Skene by expectation maximisation, on items of two labels or more."""
    items = {}
    for i, a, x in rows:
        items.setdefault(i, {})[a] = 1 if x == "yes" else -1
    multi = {i: v for i, v in items.items() if len(v) > 1}
    p, pi = {a: 0.8 for _, a, _ in rows}, 0.5
    for _ in range(rounds):
        q = {i: 1 / (1 + np.exp(-(np.log(pi / (1 - pi)) + sum(x * np.log(p[a] / (1 - p[a])) for a, x in v.items())))) for i, v in multi.items()}
        pi = np.mean(list(q.values()))
        for a in p:
            own = [(q[i] if v[a] > 0 else 1 - q[i]) for i, v in multi.items() if a in v]
            p[a] = (C.RIGHT + sum(own)) / (C.RIGHT + C.WRONG + len(own))
    return {i: x > 0.5 for i, x in q.items()}, p


def test_agrees_with_em_and_truth(spark):
    truth, rows = crowd()
    items, annotators = C.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"))
    got = {r.item: r for r in items.collect()}
    want, skill = em(rows)
    assert np.mean([(got[i].consensus == "yes") == w for i, w in want.items()]) > 0.985
    assert np.mean([(got[i].consensus == "yes") == truth[int(i[1:])] for i in want]) > 0.9
    mine = {r.annotator: r.reliability for r in annotators.collect()}
    assert all(abs(mine[a] - skill[a]) < 0.03 for a in skill)
    assert all(0 <= (r.agreement if r.agreement is not None else 0) <= 1 and (r.confidence >= 0.5 or r.n_labels == 1) for r in got.values())


def test_damping_reaches_the_same_labels(spark, monkeypatch):
    _, rows = crowd(seed=3, n=120)
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    plain, who = C.consensus(df)
    assert {r.damped for r in who.collect()} == {False}
    monkeypatch.setattr(C, "DAMPED_FROM", 2)
    damped, who = C.consensus(df)
    assert {r.damped for r in who.collect()} == {True}
    assert {r.item: r.consensus for r in plain.collect()} == {r.item: r.consensus for r in damped.collect()}
    # annotators who contradict each other throughout still come to an end
    swing = [(f"i{i}", a, "yes" if (i + k) % 2 else "no") for i in range(6) for k, a in enumerate("ab")]
    assert C.consensus(spark.createDataFrame(swing, "item string, annotator string, label string"))[0].count() == 6


def test_three_classes_and_edges(spark):
    rows = [("x", "a", "u"), ("x", "b", "u"), ("x", "c", "v"), ("y", "a", "w"), ("y", "b", "w"), ("y", "c", "w"), ("z", "c", "v"), (None, "a", "u"), ("q", None, "u"), ("q", "a", None), ("q", "b", "other"), ("x", "a", "u")]
    df = spark.createDataFrame(rows, "item string, annotator string, label string").withColumns({"k": F.lit(1), "p": F.lit("x"), "belief": F.lit(0)})
    items, annotators = C.consensus(df, ("u", "v", "w"))
    assert {r.item: (r.consensus, r.n_labels) for r in items.collect()} == {"x": ("u", 3), "y": ("w", 3), "z": ("v", 1)}
    assert annotators.count() == 3
    none, nobody = C.consensus(df.limit(0))
    assert none.count() == 0 and nobody.count() == 0


@pytest.mark.parametrize("raw, want", [("TRUE ", "yes"), ("1.0", "yes"), ("não", "no"), ("VERDADEIRO", "yes"), (" F", "no"), ("MAYBE", None), ("?", None), ("", None), (None, None)])
def test_spellings(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(C.definite(F.col("v")).alias("r")).first().r == want


def test_references(spark, mined):
    full = "845c45844c6564cded8aea67d73e33a08006865f"
    df = mined([{"repo": "o_n_00000001", "commit_hash": full}, {"repo": "o_n_00000001", "commit_hash": "1234567" + "a" * 33}, {"repo": "p_q_00000002", "commit_hash": "1234567" + "b" * 33}])
    urls = [f'=HYPERLINK("https://x.example/o/n/commit/{full}","845c458")', f"﻿https://x.example/o/n/commits/{full.upper()}?w=1\n", "https://x.example/o/n/commit/845c4584", "http://x.example/o/n/commit/1234567", "x.example/r/s/commit/1234567", "https://x.example/o/n/commit/9999999", None, "", "no url"]
    t = spark.createDataFrame([(u, "TRUE", None) for u in urls], "commit_URL string, is_bugfix string, obs string")
    got = C.resolve_commits(C.commit_refs({"a": t}), df)
    assert sorted(r.item for r in got.collect()) == sorted([full] * 3 + ["1234567" + "a" * 33])
