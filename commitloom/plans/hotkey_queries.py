"""Queries on dominant repositories, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import hotkeys
from ..sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.dominant_keys(table(spark, d, "mined_data"), "repo", 0.02).select("repo")


def p2_repo_counts(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.counts_next_to_declared(table(spark, d, "mined_data"), table(spark, d, "clone_summary"), 0.02)


QUERIES = {"p2_found": p2_found, "p2_repo_counts": p2_repo_counts}

SQL = {
    "p2_found": """
        SELECT repo FROM mined_data WHERE repo <> ''
        GROUP BY repo HAVING count(*) >= 0.02 * (SELECT count(*) FROM mined_data)""",
    "p2_repo_counts": """
        WITH per AS (
            SELECT nullif(repo, '') AS repo, count(*) AS n_rows, count(DISTINCT nullif(commit_hash, '')) AS n_members
            FROM mined_data GROUP BY 1),
        said AS (
            SELECT lower(replace(trim(repo), '/', '_')) AS k, max(commits) AS declared_commits
            FROM clone_summary WHERE repo IS NOT NULL GROUP BY 1)
        SELECT coalesce(p.repo, s.k) AS repo, coalesce(n_rows, 0)::BIGINT AS n_records, coalesce(n_members, 0)::BIGINT AS n_commits,
            declared_commits::BIGINT AS declared_commits, (declared_commits - coalesce(n_members, 0))::BIGINT AS commit_gap,
            (p.repo IS NOT NULL AND coalesce(n_rows, 0) >= 0.02 * (SELECT count(*) FROM mined_data)) AS dominant
        FROM per p FULL OUTER JOIN said s ON lower(regexp_replace(p.repo, '_[0-9a-f]{8}$', '')) = s.k""",
}
