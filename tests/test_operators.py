import json
import time

from pyspark.sql import functions as F

from commitloom.functions import paths
from commitloom.operators import diff, fold, hotkeys, records, running, sampling, stats, tokens

PATCH = """--- a/network/dns.tf
+++ b/network/dns.tf
@@ -40,3 +40,4 @@ locals {
 resource "google_dns_zone" "public" {
-  ttl = 60
+  ttl = 300
+  visibility = "public"
 }"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_diff_lines(spark):
    df = spark.createDataFrame([("a", PATCH), ("b", ""), ("c", None), ("d", "no hunk\n+x"), ("e", "@@ -5 +7,2 @@\n-a\n+b\n\\ No newline")], "id string, patch string")
    got = diff.enrich(diff.diff_lines(df))
    a = got.where("id = 'a'").orderBy("line_no").collect()
    assert len(a) == 8 and [r.change for r in a].count("added") == 2 and [r.change for r in a].count("removed") == 1
    assert [(r.old_lineno, r.new_lineno) for r in a][3:] == [(40, 40), (41, None), (None, 41), (None, 42), (42, 43)]
    assert a[3].resource_type == "google_dns_zone" and a[4].attr_name == "ttl"
    assert got.where("id IN ('b', 'c')").count() == 0 and got.where("id = 'd' AND change <> 'other'").count() == 0
    e = [tuple(r)[1:6] for r in got.where("id = 'e'").orderBy("line_no").collect()]
    assert e == [(1, "other", "@@ -5 +7,2 @@", None, None), (2, "removed", "a", 5, None), (3, "added", "b", None, 7), (4, "other", "\\ No newline", None, None)]
    assert diff.diff_lines(df.limit(0)).count() == 0
    swapped = diff.swap_sides(got.where("id = 'e'")).where("change = 'added'").first()
    assert swapped.content == "a" and swapped.new_lineno == 5
    assert [r.k for r in df.orderBy("id").select(diff.patch_kind(F.col("patch")).alias("k")).collect()] == ["diff", "empty", "empty", "content", "diff"]


def test_diff_lines_of_long_patches(spark):
    n = 100_000
    body = "".join(f" c{i}\n-r\u00e9\n+a{i}\n" for i in range(n // 4))
    text = f"@@ -1 +1 @@\n{body}@@ -9999999 +8888888,2 @@\n x"
    df = spark.createDataFrame([("long", text), ("none", None), ("short", "@@ -3 +4 @@\n+y")], "id string, patch string")
    diff.diff_lines(df.where("id = 'short'")).count()
    start = time.perf_counter()
    got = {r.line_no: tuple(r)[2:] for r in diff.diff_lines(df).where(f"id = 'short' AND line_no = 2 OR line_no IN (2, 3, 4, {3 * (n // 4) + 1}, {3 * (n // 4) + 3})").orderBy(F.desc("id")).collect()}
    assert time.perf_counter() - start < 20
    assert got == {2: ("other", "c0", 1, 1), 3: ("removed", "r\u00e9", 2, None), 4: ("added", "a0", None, 2), 3 * (n // 4) + 1: ("added", f"a{n // 4 - 1}", None, 2 * (n // 4)), 3 * (n // 4) + 3: ("other", "x", 9999999, 8888888)}


def test_fold(mined):
    df = mined([
        {"repo": "o_n_1", "commit_hash": "c1", "message": "Fix a", "file": "b.py", "patch": "p1", "date": "2024-01-01T00:00:00Z"},
        {"repo": "o_n_1", "commit_hash": "c1", "message": "later", "file": "x/main.tf", "patch": "\n".join(map(str, range(12)))},
        {"repo": "o_n_1", "commit_hash": "c2", "message": "Merge branch 'main'", "file": None, "patch": None},
        {"repo": "", "commit_hash": "c3", "file": "f"}, {"repo": None, "commit_hash": "c4"}, {"repo": "r", "commit_hash": None},
    ])
    f = fold.fold_commits(df, F.struct(F.coalesce("file", F.lit("")))).orderBy("commit_hash")
    one, two = f.collect()
    assert one.msg_original == "Fix a" and one.msg_clean == "fix a" and [m.filename for m in one.modifications] == ["b.py", "x/main.tf"]
    best = f.select(fold.best_modification(F.col("modifications")).alias("b")).collect()
    assert best[0].b.file == "x/main.tf" and best[0].b.excerpt == "\n".join(map(str, range(10)))
    assert best[1].b.file is None and best[1].b.excerpt == ""
    assert f.select(fold.files_joined(F.col("modifications")).alias("j")).collect()[1].j == "unknown_file"
    assert [r.commit_hash for r in fold.eligible(f).collect()] == ["c1"]
    first = fold.keep_first(df.where("repo = 'o_n_1'"), ["repo", "commit_hash"], [F.col("file")])
    assert first.count() == 2


def test_append_is_idempotent(mined):
    old = mined([{"commit_hash": "a", "file": "f"}, {"commit_hash": "b", "file": None}])
    new = mined([{"commit_hash": "a", "file": "f"}, {"commit_hash": "b", "file": None}, {"commit_hash": "a", "file": "g"}, {"commit_hash": "a", "file": "g"}])
    once = records.append_new(old, new)
    assert once.count() == 4 and records.append_new(once, new).count() == 4


def test_priority_union_and_filters(spark):
    a = spark.createDataFrame([("x", 1)], "name string, stars int")
    b = spark.createDataFrame([("x", 9), ("y", 5), ("My-Demo", 99)], "name string, stars int")
    got = records.priority_union([a, b], "name", [F.desc("stars")])
    assert sorted((r.name, r.stars) for r in got.collect()) == [("My-Demo", 99), ("x", 1), ("y", 5)]
    kept = records.repository_filter(b.withColumn("commits", F.lit(None).cast("int")), "name", "stars", "commits", 5, 0, ("demo",))
    assert sorted(r.name for r in kept.collect()) == ["x", "y"]
    runs = spark.createDataFrame([("x", 5, "success", 3), ("x", 5, "clone_failed", None), ("y", None, None, 0), ("My-Demo", 9, "success", 2)], "name string, stars int, status string, commits int")
    one = records.mining_summary(runs, "name", "stars", "status", "commits", {"stars": 10, "limit": None})
    r = one.first()
    assert (r.total_repositories_found, r.total_repositories_successful_clone, r.total_repositories_commits_mined_at_least_one, r.total_commits) == (4, 3, 2, 5)
    assert [tuple(x) for x in r.top_repositories_by_stars] == [("My-Demo", 9), ("x", 5), ("x", 5), ("y", None)] and [tuple(x) for x in r.statuses] == [("clone_failed", 1), ("success", 2), ("unknown", 1)]
    assert json.loads(records.summary_json(one).first().summary)["parameters"] == {"stars": "10", "limit": "None"}
    assert rows(records.processed_repositories(runs, "name", "status", "commits")) == [("My-Demo", 1, "success", 2), ("x", 2, "success", 3), ("y", 1, None, 0)]
    labels = spark.createDataFrame([("sim",), ("\u00a0FALSO ",), ("Yes",), ("?",), (None,), ("n",)], "v string").select(records.label_value(F.col("v")).alias("r"))
    assert [x.r for x in labels.collect()] == [True, False, True, None, None, False]


def test_summaries_say_what_folded_commits_say(mined):
    files = [None, "", "main.tf", "vendor/a.tf", " vendor/b.go", "docs/a.md", "x/VENDOR/y.py", "test/fixtures/z.sh"]
    patches = [None, "", "\n".join(map(str, range(14))), "one", "a\nb\n"]
    df = mined([
        {"repo": "r", "commit_hash": f"c{i % 60}", "file": files[i * 7 % len(files)], "patch": patches[i * 3 % len(patches)], "message": ["Merge branch 'main'", "Fix a", None, "Merge pull request #1 from a/b-c\n\nTitle"][i % 4], "date": "2024-01-01T00:00:00Z"}
        for i in range(200)
    ] + [{"repo": "", "commit_hash": "x"}, {"repo": "r", "commit_hash": None}])
    order = fold.content_order("file", "patch", "message", "date", "author")
    folded, short = fold.fold_commits(df, order), fold.summarise_commits(df, order)
    names = F.transform("modifications", lambda m: m["filename"])
    want = folded.select(
        "commit_hash", "msg_original", "msg_clean", "is_merge", "author_date", fold.best_modification(F.col("modifications")).alias("best"), F.size("modifications").alias("n"),
        paths.any_relevant(names).alias("a"), paths.only_vendor(names).alias("b"), paths.touches_vendor(names).alias("c"),
    )
    got = short.select("commit_hash", "msg_original", "msg_clean", "is_merge", "author_date", "best", F.col("n_files").alias("n"), F.col("relevant").alias("a"), F.col("only_vendor").alias("b"), F.col("touches_vendor").alias("c"))
    key = lambda r: r.commit_hash
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    assert {r.commit_hash for r in fold.eligible(short, True).collect()} == {r.commit_hash for r in fold.eligible(folded, True).collect()}
    assert short.where("false").count() == fold.summarise_commits(df.limit(0), order).count() == 0


def test_checks_of_samples(spark):
    days = F.timestamp_seconds(F.col("id") * 86400 + 1_598_918_400)
    df = spark.range(700).select("id", F.when(F.col("id") < 690, days).alias("at"), (F.col("id") % 10).alias("len"))
    same = {r.check: (r.value, r.ok) for r in stats.corpus_checks(df, df, "at", F.col("len"), 700, at_least=5).collect()}
    assert same == {"sample_rows": (700.0, True), "thin_months": (0.0, True), "yearly_drift": (0.0, True), "median_drift": (0.0, True), "undated": (10 / 700, True)}
    part = {r.check: r.ok for r in stats.corpus_checks(df, df.where("id < 40 AND len > 7"), "at", F.col("len"), 700).collect()}
    assert part == {"sample_rows": False, "thin_months": False, "yearly_drift": False, "median_drift": False, "undated": True}
    counts = df.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    assert stats.recount(df, counts, "len", "n").first().ok and stats.recount(df, counts.where("len <> 3"), "len", "n").first().value == 1


def test_statistics(spark):
    df = spark.createDataFrame([("2020",), ("2020",), ("2021",), (None,)], "y string")
    got = stats.shares(df, F.col("y"), "y")
    assert sorted((r.y, r.n, round(r.share, 3)) for r in got.collect()) == [("2020", 2, 0.667), ("2021", 1, 0.333)]
    assert stats.drift(got, got, "y").first().max_drift == 0
    assert stats.drift(got, got.where("y = '2020'"), "y").first().max_drift is None
    t = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int").agg(*stats.length_summary(F.col("n"))).first()
    assert (t.msg_len_mean, t.msg_len_median, t.msg_len_p10, t.msg_len_p90) == (2.5, 2.5, 1.3, 3.7)
    checks = stats.validate(df, {"rows": (F.count(F.lit(1)), F.col("value") > 9)})
    assert checks.first().ok is False


def test_samples(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") < 150, "a").when(F.col("id") < 190, "b").alias("s"), (F.col("id") % 7).alias("len"))
    assert sampling.simple_sample(df, "k", 10).count() == 10
    per = {r.stratum: r.n for r in sampling.stratified_sample(df, "k", F.col("s"), 21).groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert per == {"a": 11, "b": 11}
    q = sampling.quota_sample(df, "k", F.col("s"), F.col("len"), 60, at_least=20)
    assert q.count() == 60 and q.select("k").distinct().count() == 60
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, sampling.quota_sample(df.repartition(7), "k", F.col("s"), F.col("len"), 60, at_least=20).collect()))
    split = sampling.annotator_split(sampling.simple_sample(df, "k", 30), "k", ["p", "q"], 4)
    assert split.count() == 4 * 2 + 26 and split.select("k").distinct().count() == 30


def test_tokens(spark):
    df = spark.createDataFrame([(1, "fix the subnet subnet route"), (2, "fix the route 12"), (3, None)], "id int, t string")
    counts = tokens.token_counts(df, F.split(F.coalesce("t", F.lit("")), " "))
    assert tokens.top_tokens(counts.where("token <> ''"), 2).collect()[0].token == "fix"
    assert tokens.token_coverage(counts.where("token = 'none'")).first().coverage == 0.0
    assert [(r.bigram, r.n) for r in tokens.top_bigrams(df, F.col("t"), 2, ("the",)).collect()] == [("fix route", 1), ("fix subnet", 1)]
    assert tokens.top_bigrams(df, F.col("t"), 1, ("fix", "the", "subnet", "route", "12")).first().bigram == "fix the"
    s = tokens.stop_word_suggestions(tokens.top_tokens(counts, 9), F.lit(2)).collect()
    assert {"merge", "subnet"} <= {r.token for r in s} and "fix" not in {r.token for r in s}


def test_running_totals(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("k"), (F.col("id") % 5).alias("w")).withColumn("u", running.unit_hash(F.col("k")))
    got = running.running_totals(df, ["g"], "u", "w", ["k"], buckets=16).toPandas().sort_values(["g", "u", "k"])
    for _, part in got.groupby("g"):
        assert (part["before"].to_numpy() == part["w"].cumsum().to_numpy() - part["w"].to_numpy()).all()


# ---- dominant keys


def test_dominant_keys(spark, mined):
    many = [{"repo": "big", "commit_hash": f"c{i % 7}"} for i in range(60)] + [{"repo": "", "commit_hash": "x"}] * 20 + [{"repo": None}] * 17 + [{"repo": "small", "commit_hash": None}, {"repo": "two"}, {"repo": "two"}]
    df = mined(many)
    assert sorted(r.repo for r in hotkeys.dominant_keys(df, "repo", 0.02).collect()) == ["big", "two"]  # 2 of 100 rows is just enough
    assert hotkeys.dominant_keys(df.limit(0), "repo").count() == 0
    clash = df.withColumns({"n_rows": F.lit("x"), "n_members": F.lit(1), "row_share": F.lit(None), "__m": F.lit(2)})
    assert sorted(r.repo for r in hotkeys.dominant_keys(clash, "repo", 0.02).collect()) == ["big", "two"]
    per = {r.repo: (r.n_rows, r.n_members) for r in hotkeys.key_counts_distinct(clash, "repo", F.col("commit_hash")).collect()}
    assert per["big"] == (60, 7) and per["small"] == (1, 0) and per[None] == (17, 0)


def test_counts_next_to_declared(spark, mined):
    df = mined([{"repo": "o_n_0123abcd", "commit_hash": "a"}, {"repo": "o_n_0123abcd", "commit_hash": "a"}, {"repo": None, "commit_hash": "b"}, {"repo": ""}])
    said = spark.createDataFrame([("O/N", 5, "again"), ("o/n", None, "x"), ("q/none", 3, "y"), (None, 4, "z")], "repo string, commits int, n_records string")
    got = {r.repo: r for r in hotkeys.counts_next_to_declared(df, said).collect()}
    assert (got["o_n_0123abcd"].n_records, got["o_n_0123abcd"].n_commits, got["o_n_0123abcd"].declared_commits, got["o_n_0123abcd"].dominant) == (2, 1, 5, True)
    assert got["q_none"].n_records == 0 and got["q_none"].commit_gap == 3 and not got["q_none"].dominant
    assert got[None].n_records == 2 and not got[None].dominant
    assert hotkeys.counts_next_to_declared(df.limit(0), said.limit(0)).count() == 0
