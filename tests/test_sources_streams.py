import http.server
import json
import re
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from commitloom import schemas
from commitloom.config import result_summary, settings
from commitloom.operators import fold
from commitloom.operators.records import append_new
from commitloom.plans import pipelines
from commitloom.sources import connectors, files, sinks
from commitloom.streaming import ingest


def record(i, **more):
    return {"repo": "o_n", "commit_hash": f"c{i}", "author": "a", "date": "2024-01-01T00:00:00Z", "message": "Fix bug", "file": "main.tf", "patch": "@@ -1 +1 @@\n+é", "head_hash": "h", **more}


def test_jsonl_reader_skips_bad_lines(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "data.jsonl").write_text(json.dumps(record(1)) + "\nnot json\n" + json.dumps(record(2)) + "\n", encoding="utf-8")
    df = files.read_mined(spark, str(tmp_path / "*" / "data.jsonl"))
    assert sorted(r.commit_hash for r in df.collect()) == ["c1", "c2"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", "TRUE", 'a "quoted"\nline, two'), ("u2", None, "")], schemas.ANNOTATION)
    sinks.write_csv(df.coalesce(1), str(tmp_path / "x"))
    got = {r.commit_URL: r.obs for r in files.read_annotations(spark, str(tmp_path / "x")).collect()}
    assert got["u1"] == 'a "quoted"\nline, two'


def test_append_and_lines(spark, mined, tmp_path):
    df = mined([record(1), record(1), record(2)])
    assert sinks.append_mined(df, str(tmp_path / "p")) == 2
    assert sinks.append_mined(df, str(tmp_path / "p")) == 0
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_jsonl(df, str(tmp_path / "j"), by="repo")
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.write_bigrams(spark.createDataFrame([("a b", 3), ("c d", 5)], "bigram string, n bigint"), str(tmp_path / "b.json"))
    assert [(r.bigram, r.n) for r in files.read_bigrams(spark, str(tmp_path / "b.json")).collect()] == [("c d", 5), ("a b", 3)]
    (tmp_path / "s.yaml").write_text("custom_stopwords:\n  - pull request\n  - 12\n  - x\n")
    assert files.load_stop_words(str(tmp_path / "s.yaml")) == ("pull", "request")
    assert files.load_yaml(str(tmp_path / "none.yaml")) == {}
    with pytest.raises(FileNotFoundError):
        files.load_yaml(str(tmp_path / "none.yaml"), required=True)
    with pytest.raises(ValueError, match="missing columns: nope"):
        schemas.require_columns(df, ["nope"])


def test_git_log_source(spark, tmp_path):
    repo = tmp_path / "clone"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "main.tf").write_text("a = 1\n")
    run("add", "."), run("commit", "-qm", "first")
    first = subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    (repo / "main.tf").write_text("a = 2\n")
    (repo / "x.md").write_text("hi\n")
    run("add", "."), run("commit", "-qm", "Fix a\n\nbody")
    connectors.register(spark)
    got = spark.read.format("git_log").option("repos", str(repo)).option("suffix", ".tf").load()
    assert {(r.message, r.file) for r in got.collect()} == {("first", "main.tf"), ("Fix a\n\nbody", "main.tf")}
    new = spark.read.format("git_log").option("repos", str(repo)).option("since", first).load()
    assert new.count() == 2 and "+a = 2" in new.where("file = 'main.tf'").first().patch
    bad = spark.read.format("git_log").option("repos", f"{repo},{tmp_path / 'nowhere'}").load()
    assert {r.patch_kind for r in bad.collect()} == {"diff", "failed"}
    assert append_new(got.drop("patch_kind"), new.drop("patch_kind")).count() == 3


def test_git_log_slices_and_damaged_clones(spark, tmp_path):
    repo = tmp_path / "c1"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    for i in range(7):
        (repo / "main.tf").write_text(f"a = {i}\n" + "é" * 30_000 + "\n")
        (repo / ("é5.tf" if i == 5 else f"f{i}.tf")).write_text(f"b = {i}\n")
        run("add", "."), run("commit", "-qm", f"step {i}")
    connectors.register(spark)
    read = lambda **o: spark.read.format("git_log").options(repos=str(repo), suffix=".tf", **o).load().collect()
    whole, sliced = read(), read(slice="2")
    assert sorted(map(tuple, whole)) == sorted(map(tuple, sliced)) and len(whole) == 14 and {r.patch_kind for r in whole} == {"diff"}
    assert "é5.tf" in {r.file for r in whole}
    heads = {r.message: r.commit_hash for r in whole}
    entries = [list(connectors._entries(str(repo), [connectors._FORMAT, "-p", "HEAD"], chunk)) for chunk in (1 << 20, 4099, 7)]
    assert len(entries[0]) == 7 and entries[0] == entries[1] == entries[2]
    since = json.dumps({"c1": heads["step 4"]})
    assert {r.message for r in read(since=since)} == {"step 5", "step 6"} and len(read(since=json.dumps({"c1": "f" * 40}))) == 14
    points = connectors.resume_points(spark.createDataFrame(whole).drop("patch_kind"))
    assert points.first().total_commits_processed == 7 and json.loads(connectors.resume_option(points)) == {"c1": heads["step 6"]}
    # a clone without one blob: no diff of the commits around it, so the changed files as they are
    blob = run("rev-parse", f"{heads['step 3']}:main.tf")
    (repo / ".git" / "objects" / blob[:2] / blob[2:]).unlink()
    kinds = {(r.message, r.file): r.patch_kind for r in read()}
    assert kinds[("step 3", "f3.tf")] == kinds[("step 4", "main.tf")] == "content" and kinds[("step 6", "f6.tf")] == kinds[("step 0", "f0.tf")] == "diff" and len(kinds) == 14
    # without the tree of a parent, all files of the commit
    tree = run("rev-parse", f"{heads['step 0']}^{{tree}}")
    (repo / ".git" / "objects" / tree[:2] / tree[2:]).unlink()
    kinds = {(r.message, r.file): r.patch_kind for r in read()}
    assert kinds[("step 1", "f1.tf")] == kinds[("step 1", "f0.tf")] == "tree" and any(f is None and k == "failed" for (m, f), k in kinds.items() if m == "step 0")


def test_search_service(spark):
    asked, failing = [], {"/search/repositories": 1}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            asked.append(path)
            limited = failing.get(path, 0) > 0
            failing[path] = failing.get(path, 0) - 1
            self.send_response(429 if limited else 404 if path == "/repos/o/gone/commits" else 200)
            self.send_header("X-RateLimit-Remaining", "0" if limited else "50")
            self.send_header("X-RateLimit-Reset", str(time.time()))
            if path == "/repos/o/n/commits":
                self.send_header("Link", '<http://x/commits?per_page=1&page=2>; rel="next", <http://x/commits?per_page=1&page=37>; rel="last"')
            self.end_headers()
            page = re.search(r"page=(\d+)$", query)
            first = page is None or page[1] == "1"
            self.wfile.write(json.dumps({"items": [{"full_name": f"o/{x}", "stargazers_count": 9, "forks_count": 1} for x in ("n", "gone")] if first else []} if "search" in path else [{}]).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, naps = f"http://127.0.0.1:{server.server_port}", []
    service = connectors.SearchService(url, sleep=naps.append)
    assert len(service.get("/search/repositories", q="x")[0]["items"]) == 2 and len(naps) == 1 and naps[0] > 4  # waited for the reset, then asked again
    assert [service.commit_count(x) for x in ("o/n", "o/gone", "o/one")] == [37, 0, 1]
    connectors.register(spark)
    rows = spark.read.format("repo_search").options(endpoint=url, limit="5").load().where("priority < 2").collect()
    assert sorted((r.repo_full_name, r.commits, r.priority, r.position) for r in rows) == [("o/gone", 0, 0, 1), ("o/gone", 0, 1, 1), ("o/n", 37, 0, 0), ("o/n", 37, 1, 0)]
    server.shutdown()


def test_clones(spark, tmp_path):
    origin = tmp_path / "remote" / "o" / "n"
    origin.mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (origin / "main.tf").write_text("a = 1\n")
    run("add", "."), run("commit", "-qm", "Fix first")
    names = spark.createDataFrame([("o/n",), ("o/n",), ("o/gone",), (None,)], "name string")
    make = lambda: {r.repo: r for r in connectors.clone_repositories(names, "name", f"file://{tmp_path / 'remote'}", str(tmp_path / "clones"), retries=2, delay=0).collect()}
    got = make()
    assert got["o/n"].status == "success" and got["o/gone"].status == "clone_failed" and got["o/gone"].reason
    assert make()["o/n"].path == got["o/n"].path  # fetched, not cloned again
    connectors.register(spark)
    assert spark.read.format("git_log").option("repos", got["o/n"].path).load().first().message == "Fix first"


def test_repo_search_source(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps([{"repo_full_name": "a/b", "stars": 5, "forks": 1, "commits": None}]))
    (tmp_path / "1.json").write_text("broken")
    (tmp_path / "2.json").write_text(json.dumps([{"repo_full_name": "a/b", "stars": 6}, {"repo_full_name": "c/d", "stars": 1}]))
    connectors.register(spark)
    rows = spark.read.format("repo_search").option("path", str(tmp_path)).load().orderBy("priority", "position").collect()
    assert [(r.repo_full_name, r.commits, r.priority) for r in rows] == [("a/b", 0, 0), ("a/b", 0, 2), ("c/d", 0, 2)]


def test_discovery(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps([{"repo_full_name": "a/low", "stars": 1}, {"repo_full_name": "a/Demo-x", "stars": 99}, {"repo_full_name": "a/b", "stars": 50, "commits": 3}]))
    (tmp_path / "1.json").write_text(json.dumps([{"repo_full_name": "a/low", "stars": 20}, {"repo_full_name": "c/d", "stars": 60}]))
    connectors.register(spark)
    s = settings(None, stars="15", limit=2, exclude_keywords=["demo"])
    assert [r.repo_full_name for r in pipelines.discover(spark, str(tmp_path), s).collect()] == ["a/b", "a/low"]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("stars: 500\nlimit: many\nsampling:\n  sample_size: 7\nkeywords: [a, b]\nother: 1\n")
    s = settings(str(tmp_path / "c.yaml"), stars=3, min_commits=None)
    assert (s.stars, s.limit, s.sample_size, s.keywords, s.min_commits, s.extra) == (3, 50, 7, ("a", "b"), 0, {"other": 1})
    assert result_summary(str(tmp_path)) == {"c.yaml": (tmp_path / "c.yaml").stat().st_size} and result_summary(str(tmp_path / "no")) == {}
    assert pipelines.compiled_stop_words(("A", "b"), ("a",)) == ("a", "b")


def test_cluster_commits(spark, mined):
    topics = ["subnet route table gateway", "certificate rotation expiry alarm"]
    rows = [record(i, message=f"Fix {topics[i % 2]}", file="main.tf") for i in range(40)] + [record(99, message="Merge branch 'x'"), record(98, file="docs/a.md")]
    folded = fold.fold_commits(mined(rows), F.struct(F.col("file")))
    got = pipelines.cluster_commits(folded, settings(None, min_cluster_size=10, min_samples=5)).toPandas()
    # the merge says something once its branch stands for it, and is noise; the document is not relevant
    assert len(got) == 41 and got.groupby("msg_original").hdbscan_cluster_label.nunique().max() == 1
    assert sorted(got.hdbscan_cluster_label.unique()) == [-1, 0, 1] and (got.hdbscan_cluster_label == -1).sum() == 1


def test_incremental_ingest(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "1.jsonl").write_text(json.dumps(record(1)) + "\n" + json.dumps(record(2, file="docs/x.tf")) + "\n")
    ingest.ingest_jsonl(spark, str(src), out, ck, only_fixes=True).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    (src / "2.jsonl").write_text(json.dumps(record(1)) + "\n" + json.dumps(record(3)) + "\n")
    ingest.ingest_jsonl(spark, str(src), out, ck, only_fixes=True).awaitTermination()
    assert sorted(r.commit_hash for r in spark.read.parquet(out).collect()) == ["c1", "c3"]


def test_windowed_counts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' ts, 'a' k, 1.0D v UNION ALL SELECT timestamp'2024-01-01 23:59:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-02 00:00:00', 'a', 4.0D")
    got = ingest.windowed_counts(df, "ts", "k", F.col("v"))
    assert sorted((str(r.window_start), r.n, r.total) for r in got.collect()) == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-02 00:00:00", 1, 4.0)]
