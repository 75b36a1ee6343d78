"""Declared schemas of the engine's entities and a column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


REPO_CANDIDATE = "repo_full_name STRING, stars INT, forks INT, commits INT"
MINED = "repo STRING, commit_hash STRING, author STRING, date STRING, message STRING, file STRING, patch STRING, head_hash STRING"
CHECKPOINT = "processed_commits ARRAY<STRING>, last_head STRING, last_updated STRING, total_commits_processed INT"
REPO_RESULT = REPO_CANDIDATE + ", status STRING, reason STRING, mined_commits INT, total_mined INT"
MODIFICATION = "STRUCT<filename: STRING, new_path: STRING, old_path: STRING, diff: STRING>"
FOLDED_MINER = "commit_hash STRING, repo_name STRING, date STRING, author_name STRING, msg_original STRING, msg_clean STRING, relevant_file STRING, patch_excerpt STRING, is_merge BOOLEAN"
FOLDED_NLP = f"repo_name STRING, commit_hash STRING, msg_original STRING, author_name STRING, author_date TIMESTAMP, modifications ARRAY<{MODIFICATION}>, is_merge BOOLEAN"
SAMPLE_ROW = "commit_hash STRING, repo_name STRING, msg_clean STRING, file STRING, patch_excerpt STRING, author_date TIMESTAMP, msg_len INT"
TOKEN_FREQ = "token STRING, freq BIGINT"
CLUSTERED = "repo_name STRING, commit_hash STRING, author_name STRING, author_date STRING, msg_original STRING, msg_clean_for_val STRING, hdbscan_cluster_label INT, hdbscan_cluster_probability DOUBLE"
DIFF_LINE = "change STRING, content STRING, old_lineno INT, new_lineno INT, resource_type STRING, attr_name STRING, repo STRING, commit STRING, date STRING, file_path STRING"
ANNOTATION = "commit_URL STRING, is_bugfix STRING, obs STRING"
AST_ATTRIBUTE = "path STRING, value STRING"
AST_EDGE = "src STRING, dst STRING"
CLONE_SUMMARY = "repo STRING, stars INT, status STRING, commits INT"


def schema(ddl: str) -> T.StructType:
    """The StructType of one of this module's DDL strings."""
    return T.StructType.fromDDL(ddl)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; present: {', '.join(df.columns)}")
    return df
