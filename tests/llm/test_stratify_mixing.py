import numpy as np
import pytest
from pyspark.sql import functions as F

from commitloom.llm import mixing as M
from commitloom.llm import stratify as S

CATS = ["year_month", "msg_len_category"]


def items(spark, sizes):
    rows = [(f"{m}{c}{i}", m, c) for (m, c), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "commit_hash string, year_month string, msg_len_category string")


def test_sample_meets_targets(spark):
    df = items(spark, {("2024-01", "short"): 900, ("2024-01", "long"): 90, ("2024-02", "short"): 10})
    targets = spark.createDataFrame([(1, "2024-01", "short", 0.5, 1), (2, "2024-01", "long", 0.48, 1), (3, "2024-02", "short", 0.001, 4), (4, "2024-03", "long", 0.019, 2), (5, None, "long", None, None)], "target_id int, year_month string, msg_len_category string, target_share double, min_rows int")
    sample, report = S.sample_to_targets(df, "commit_hash", CATS, targets)
    got = {r.target_id: (r.wanted, r.available, r.drawn, r.deficit) for r in report.collect()}
    assert got == {1: (100, 900, 100, 0), 2: (96, 90, 90, 6), 3: (4, 10, 4, 0), 4: (4, 0, 0, 4), 5: (0, 0, 0, 0)}
    assert sample.count() == sample.select("commit_hash").distinct().count() == 194
    same = S.sample_to_targets(df.repartition(5), "commit_hash", CATS, targets)[0]
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, sample.collect()))
    # even without any oversampling the counts are exact
    tight = S.sample_to_targets(df, "commit_hash", CATS, targets, oversample=0.5, slack=0.0)[1]
    assert {r.target_id: r.drawn for r in tight.collect()} == {k: v[2] for k, v in got.items()}
    none = S.sample_to_targets(df.limit(0), "commit_hash", CATS, targets)
    assert none[0].count() == 0 and none[1].where("deficit > 0").count() == 4  # minima stay, shares of nothing are nothing


def test_eligible(mined):
    df = mined([
        {"commit_hash": "a", "message": "x" * 101, "date": "2024-01-31T23:30:00-02:00"}, {"commit_hash": "a", "message": "x" * 101, "date": "2024-02-01T01:30:00Z"}, {"commit_hash": "b", "message": "", "date": "Tue Feb 8 15:02:38 2022 +0900"},
        {"commit_hash": "c", "message": None, "date": "2024-01-01T00:00:00Z"}, {"commit_hash": "d", "message": "m", "date": "unknown"}, {"commit_hash": "", "message": "m", "date": "2024-01-01T00:00:00Z"}, {"message": "m", "date": "2024-01-01T00:00:00Z"},
    ]).withColumns({"ts": F.lit(1), "len": F.lit("q"), "year_month": F.lit("z")})
    assert sorted(map(tuple, S.eligible_commits(df).collect())) == [("a", "2024-02", "long"), ("b", "2022-02", "short")]
    assert S.eligible_commits(df.limit(0)).count() == 0


def test_splitting_tree():
    out = M.split_quotas([1000, 10, 0, 333], 7, 5)
    assert out.shape == (7, 4) and out.sum(0).tolist() == [1000, 10, 0, 333] and (out >= 0).all()
    sums = out.sum(1)
    assert sums.max() - sums.min() <= 7
    mean = np.mean([M.split_quotas([60, 30], 3, s)[0] for s in range(200)], axis=0)
    assert np.allclose(mean, [20, 10], atol=1.5)
    assert M.split_quotas([], 3, 0).sum() == 0 and M.split_quotas([5], 0, 0).size == 0


def test_tasks_split_the_tree_as_one_would(spark, monkeypatch):
    monkeypatch.setattr(M, "TOP", 8)
    blocks, shards = [700, 0, 91, 3], 77
    rows = M.dealt_blocks(spark, ["a", "b", "c", "d"], blocks, shards, 5).collect()
    want = M.split_quotas(blocks, shards, 5)
    got = np.zeros_like(want)
    for r in rows:
        got[r.shard, "abcd".index(r.source)] = r.hi - r.lo + 1
    assert (got == want).all()
    for k, name in enumerate("abcd"):
        assert sorted(b for r in rows if r.source == name for b in range(r.lo, r.hi + 1)) == list(range(blocks[k]))
    assert M.dealt_blocks(spark, [], [], 3, 5).count() == 0


def test_mix(spark):
    rows = [(i, "w " * (i % 9 + 1), s) for i, s in enumerate(["a"] * 600 + ["b"] * 30 + ["c"] * 100)] + [(900, "x", None), (901, None, "a"), (902, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumns({"n_tokens": F.lit("q"), "before": F.lit(1), "tokens": F.lit(2), "quota": F.lit(3)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.05, 2), ("d", 0.05, 9), ("e", None, None), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    mix, report = M.mix_sources(docs, targets, shard_tokens=300)
    total = sum(len(t.split()) for _, t, _ in rows if t)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert {s for s, r in got.items() if r.short} == {"b", "d"}
    assert abs(got["a"].drawn - 0.25 * total) <= 5 and abs(got["c"].drawn - 0.025 * total) <= 5
    assert got["b"].drawn == 3 * got["b"].tokens and got["b"].max_copies == 3 and got["a"].max_copies == 1
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
    pdf = mix.toPandas()
    assert not pdf.duplicated(["source", "doc_id", "copy_no"]).any() and not pdf.duplicated(["shard", "slot"]).any()
    per = pdf.groupby("shard").n_tokens.sum()
    assert len(per) > 3 and per.max() < 2 * per.min()
    assert {r.source: r.drawn for r in M.mix_sources(docs.repartition(3), targets, shard_tokens=300)[1].collect()} == {s: r.drawn for s, r in got.items()}
    empty = M.mix_sources(docs.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].where("drawn > 0").count() == 0
    assert M.mix_sources(docs, targets.limit(0))[1].count() == 0


@pytest.mark.parametrize("weight", [0.0, 1.0])
def test_one_source_holds_everything(spark, weight):
    docs = spark.createDataFrame([(i, "same text here", "hot") for i in range(500)], "doc_id int, text string, source string")
    mix, report = M.mix_sources(docs, spark.createDataFrame([("hot", weight, 1)], "source string, target_weight double, max_repeats int"))
    assert abs(report.first().drawn - weight * 750) <= 3 and mix.count() == report.first().drawn / 3
