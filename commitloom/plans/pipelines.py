"""Compositions of operators: discovery, clustering input, message source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text
from ..operators import density, fold, records
from ..operators.embed import tfidf


def discover(spark: SparkSession, path: str, s: Settings) -> DataFrame:
    """Repositories of saved search results in priority order: filtered, each once, at most ``limit``.

    A repository that its first result hides by a low star count may still come from a later one.
    """
    found = spark.read.format("repo_search").option("path", path).load()
    kept = records.repository_filter(found, "repo_full_name", "stars", "commits", s.stars, s.min_commits, s.exclude_keywords)
    first = fold.keep_first(kept, ["repo_full_name"], [F.col("priority"), F.col("position")])
    return first.orderBy("priority", "position").limit(s.limit).select("repo_full_name", "stars", "forks", "commits")


def message_source(df: DataFrame) -> Column:
    """The best column of messages that a table has: cleaned, cleaned on the spot, or none."""
    if "msg_clean" in df.columns:
        return F.col("msg_clean")
    return text.clean_message(F.col("msg_original")) if "msg_original" in df.columns else F.lit(None).cast("string")


def clustering_input(folded: DataFrame, s: Settings) -> DataFrame:
    """Folded commits to cluster: all of them, or those that are no merges and touch relevant files; repeated keys once if asked for."""
    rows = folded
    if not s.cluster_all:
        rows = rows.join(fold.eligible(folded, s.require_patch).select("repo_name", "commit_hash"), ["repo_name", "commit_hash"], "left_semi")
    return fold.keep_first(rows, ["repo_name", "commit_hash"], [F.col("author_date")]) if s.cluster_distinct else rows


def cluster_commits(folded: DataFrame, s: Settings, dims: int = 256) -> DataFrame:
    """Clustered commits: the input's columns with ``hdbscan_cluster_label`` and ``hdbscan_cluster_probability``, joined by key."""
    rows = clustering_input(folded, s).withColumn("msg_clean_for_val", text.clean_basic(F.col("msg_original"))).withColumn("__k", F.concat_ws("|", "repo_name", "commit_hash"))
    size, samples = density.cluster_parameters(rows.count(), s.min_cluster_size, s.min_samples)
    labels = density.cluster_by_density(tfidf(rows, F.col("msg_clean_for_val"), dims), "__k", "embedding", size, samples, epsilon=s.epsilon)
    out = rows.join(labels.withColumnsRenamed({"label": "hdbscan_cluster_label", "probability": "hdbscan_cluster_probability"}), "__k", "left")
    return out.select("repo_name", "commit_hash", "author_name", F.col("author_date").cast("string").alias("author_date"), "msg_original", "msg_clean_for_val", "hdbscan_cluster_label", "hdbscan_cluster_probability")


def compiled_stop_words(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """Several stop-word lists as one, in lower case, sorted, each word once."""
    return tuple(sorted({w.lower() for words in lists for w in words}))
