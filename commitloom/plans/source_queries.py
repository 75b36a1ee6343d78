"""Queries that write tables in the engine's file formats and read them back, with SQL over the tables themselves."""

from __future__ import annotations

import json
import subprocess
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..lineage import ensure_checkpoint_dir
from ..operators import report, tokens
from ..operators.records import priority_union
from ..sources import connectors, files, sinks
from ..sources.tables import table
from . import pipelines
from .corpus_queries import SQL as CORPUS_SQL
from .corpus_queries import top_bigrams

ANNOTATORS = ("heleno", "isadora", "vania", "joao")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _local(folder: str) -> Path:
    path = Path(folder.removeprefix("file:"))
    path.mkdir(parents=True, exist_ok=True)
    return path


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Mined records as JSON Lines, one folder a repository."""
    folder = _folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "mined_data").withColumn("part", F.pmod(F.xxhash64("repo"), F.lit(16))), folder, by="part")
    back = files.read_mined(spark, f"{folder}/part=*")
    return back.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count("message").alias("n_messages"), F.sum(F.length("patch")).alias("patch_chars"), F.count_distinct("file").alias("n_files"), F.min("date").alias("first"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Annotators' tables as CSV with all fields quoted; empty fields come back as null."""
    out = None
    for a in ANNOTATORS:
        folder = _folder(spark, "csv")
        sinks.write_csv(table(spark, d, f"sample_{a}"), folder)
        own = files.read_annotations(spark, folder).groupBy(F.lit(a).alias("annotator")).agg(F.count(F.lit(1)).alias("n"), F.count("commit_URL").alias("n_urls"), F.count("is_bugfix").alias("n_labels"), F.count_if(F.coalesce("obs", F.lit("")).contains("\n")).alias("n_long"))
        out = own if out is None else out.unionByName(own)
    return out


def bigram_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent bigrams as a JSON list."""
    path = f"{_local(_folder(spark, 'bigrams'))}/bigrams.json"
    sinks.write_bigrams(top_bigrams(spark, d), path)
    return files.read_bigrams(spark, path)


def stop_word_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent bigrams as suggestions in YAML, read back as single stop words."""
    path = _local(_folder(spark, "stops")) / "stops.yaml"
    path.write_text(report.suggestions_text(top_bigrams(spark, d).select(F.col("bigram").alias("token"))), encoding="utf-8")
    return spark.createDataFrame([(w,) for w in files.load_stop_words(str(path))], "token string")


def phrase_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of the most frequent bigrams, as a table."""
    return tokens.parse_suggestions(top_bigrams(spark, d), "bigram")


def _saved_searches(spark: SparkSession, d: str) -> str:
    """Three lists of repositories as JSON: by stars, by commits, all."""
    folder = _local(_folder(spark, "search"))
    rows = table(spark, d, "clone_summary").where("repo IS NOT NULL").orderBy(F.desc("stars"), F.desc("commits"), "repo").collect()  # does not grow
    for i, keep in enumerate((lambda r: (r.stars or 0) >= 1500, lambda r: (r.commits or 0) >= 300, lambda r: True)):
        (folder / f"{i}.json").write_text(json.dumps([{"repo_full_name": r.repo, "stars": r.stars, "forks": None, "commits": r.commits} for r in rows if keep(r)]))
    connectors.register(spark)
    return str(folder)


def search_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Saved search results, read by the search source: each repository once, from the earliest list that has it."""
    folder = _saved_searches(spark, d)
    found = spark.read.format("repo_search").option("path", folder).load()
    lists = [found.where(F.col("priority") == i).drop("priority", "position") for i in range(3)]
    order = [F.coalesce("stars", F.lit(-1)).desc(), F.col("commits").desc()]
    return priority_union(lists, "repo_full_name", order).select(F.col("repo_full_name").alias("repo"), "stars", "commits", "priority")


def discovery(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of saved search results with enough stars and commits, each once, at most 40."""
    return pipelines.discover(spark, _saved_searches(spark, d), settings(stars=300, min_commits=50, limit=40, exclude_keywords=["demo"])).select(F.col("repo_full_name").alias("repo"), "stars", "commits")


def git_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A clone with one commit a nation, which adds a line to the file of its region, read by the log source in slices."""
    clone = _local(_folder(spark, "clone"))
    git = lambda *a, **k: subprocess.run(["git", "-C", str(clone), *a], check=True, capture_output=True, **k)
    git("init", "-q")
    stream = []
    texts: dict[int, str] = {}
    for i, r in enumerate(table(spark, d, "nation").orderBy("n_nationkey").collect(), 1):  # 25 rows
        texts[r.n_regionkey] = texts.get(r.n_regionkey, "") + f"{r.n_name}\n"
        body = texts[r.n_regionkey]
        stream.append(f"commit refs/heads/main\ncommitter x <x@example.org> {1_700_000_000 + i} +0000\ndata {len(r.n_name.encode())}\n{r.n_name}\nM 100644 inline region{r.n_regionkey}.tf\ndata {len(body.encode())}\n{body}\n")
    git("fast-import", "--quiet", input="".join(stream).encode())
    git("symbolic-ref", "HEAD", "refs/heads/main")
    connectors.register(spark)
    log = spark.read.format("git_log").options(repos=str(clone), suffix=".tf", slice="10").load()
    added = F.regexp_count("patch", F.lit(r"(?m)^\+"))
    return log.select("message", "file", "patch_kind", added.cast("bigint").alias("n_added"))


QUERIES = {f.__name__: f for f in (jsonl_round_trip, csv_round_trip, bigram_round_trip, stop_word_round_trip, phrase_words, search_round_trip, discovery, git_log_round_trip)}

_PHRASE_WORDS = f"SELECT DISTINCT token FROM (SELECT unnest(string_split(bigram, ' ')) AS token FROM ({CORPUS_SQL['top_bigrams']}) b) t WHERE length(token) > 1 AND NOT regexp_matches(token, '^[0-9]+$')"

SQL = {
    "jsonl_round_trip": "SELECT repo, count(*) AS n, count(message) AS n_messages, sum(length(patch))::BIGINT AS patch_chars, count(DISTINCT file) AS n_files, min(date) AS first FROM mined_data GROUP BY 1",
    "csv_round_trip": " UNION ALL ".join(
        f"SELECT '{a}' AS annotator, count(*) AS n, count(nullif(commit_URL, '')) AS n_urls, count(nullif(is_bugfix, '')) AS n_labels, count(*) FILTER (contains(coalesce(obs, ''), chr(10))) AS n_long FROM sample_{a}" for a in ANNOTATORS
    ),
    "bigram_round_trip": CORPUS_SQL["top_bigrams"],
    "stop_word_round_trip": _PHRASE_WORDS,
    "phrase_words": _PHRASE_WORDS,
    "search_round_trip": """
        WITH c AS (SELECT repo, stars, coalesce(commits, 0) AS commits FROM clone_summary WHERE repo IS NOT NULL), l AS (
            SELECT *, 0 AS priority FROM c WHERE stars >= 1500 UNION ALL SELECT *, 1 FROM c WHERE commits >= 300 UNION ALL SELECT *, 2 FROM c)
        SELECT repo, stars, commits, priority FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority, coalesce(stars, -1) DESC, commits DESC) AS rn FROM l) t WHERE rn = 1""",
    "discovery": """
        WITH c AS (SELECT repo, stars, coalesce(commits, 0) AS commits FROM clone_summary WHERE repo IS NOT NULL), l AS (
            SELECT *, 0 AS priority FROM c WHERE stars >= 1500 UNION ALL SELECT *, 1 FROM c WHERE commits >= 300 UNION ALL SELECT *, 2 FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority, stars DESC, commits DESC) AS rn FROM l WHERE NOT contains(lower(repo), 'demo') AND coalesce(stars, 0) >= 300 AND commits >= 50)
        SELECT repo, stars, commits FROM k WHERE rn = 1 ORDER BY priority, stars DESC, commits DESC, repo LIMIT 40""",
    "git_log_round_trip": "SELECT n_name AS message, 'region' || n_regionkey || '.tf' AS file, 'diff' AS patch_kind, 1::BIGINT AS n_added FROM nation",
}
