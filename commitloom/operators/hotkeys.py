"""Per-key results when a few keys hold most records.

Every aggregate here is algebraic, so Spark's hash aggregate combines rows inside
each input partition (spilling to a sort when its table is full) and only one
compact state per key and partition is shuffled: a key holding a third of all
rows sends as little as any other. Distinct counts are taken in two steps on the
pair (key, member), which spreads a hot key's members over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``key, n_rows``; the null key is a group like any other."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def key_counts_distinct(df: DataFrame, key: str, member: Column) -> DataFrame:
    """``key, n_rows, n_members``: rows, and distinct non-null members, of each key.

    First step by (key, member), second by key over the partial rows, both with
    map-side combining. A null or empty member counts as a row but not a member.
    """
    pairs = df.select(F.col(key), F.nullif(member, F.lit("")).alias("__m")).groupBy(key, "__m").agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(key).agg(F.sum("__n").alias("n_rows"), F.count("__m").alias("n_members"))


def dominant_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """``key, n_rows, row_share`` of the non-empty keys that hold at least ``share`` of all rows.

    The total counts every row, also those whose key is null or empty; it comes
    from the files' footers and is joined as a scalar. Equal counts are all kept. An
    empty table gives no rows; other columns are ignored whatever their names.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = key_counts(df, key).where((F.col(key).isNotNull()) & (F.col(key) != ""))
    return counts.withColumn("row_share", F.col("n_rows") / total).where(F.col("n_rows") >= F.lit(share) * total)


def declared_key(repo: Column) -> Column:
    """``owner/name`` in lower case as ``owner_name``, to meet ``owner_name_hash`` of mined rows."""
    return F.lower(F.replace(F.trim(repo), F.lit("/"), F.lit("_")))


def counts_next_to_declared(mined: DataFrame, declared: DataFrame, share: float = 0.02) -> DataFrame:
    """Records and commits of each mined repository, next to the declared number of commits.

    mined: ``repo, commit_hash``; declared: ``repo, commits`` where a repository
    may occur several times (the largest non-null number counts). Returns ``repo,
    n_records, n_commits, declared_commits, commit_gap, dominant``; rows without a
    repository are one row with a null ``repo``. Declared repositories without
    mined rows are kept with zeros under their declared name.
    """
    total = mined.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = key_counts_distinct(mined.select(F.nullif(F.col("repo"), F.lit("")).alias("repo"), "commit_hash"), "repo", F.col("commit_hash"))
    per = per.withColumn("__k", F.lower(F.regexp_replace("repo", "_[0-9a-f]{8}$", "")))
    said = declared.where(F.col("repo").isNotNull()).groupBy(declared_key(F.col("repo")).alias("__k")).agg(F.max("commits").alias("declared_commits"))
    out = per.join(said, "__k", "full_outer")
    return out.select(
        F.coalesce("repo", "__k").alias("repo"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_records"),
        F.coalesce("n_members", F.lit(0)).cast("bigint").alias("n_commits"),
        F.col("declared_commits").cast("bigint").alias("declared_commits"),
        (F.col("declared_commits") - F.coalesce("n_members", F.lit(0))).cast("bigint").alias("commit_gap"),
        (F.col("repo").isNotNull() & (F.coalesce("n_rows", F.lit(0)) >= F.lit(share) * total)).alias("dominant"),
    )
