"""Idempotent appends, deduplicating unions and repository filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_only(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key (nulls equal) ``existing`` lacks; repeats within ``new`` stay."""
    seen = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return new.join(seen, cond, "left_anti")


def append_new(existing: DataFrame, new: DataFrame, keys: list[str] = ["commit_hash", "file"]) -> DataFrame:  # noqa: B006
    """``existing`` and the rows of ``new`` whose key it lacks."""
    return existing.unionByName(new_only(new, existing, keys))


def seen_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of both."""
    return a.select(key).union(b.select(key)).distinct()


def priority_union(results: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """All rows of several result lists, each key once: from the earliest list, there the first in ``order``."""
    tagged = reduce(DataFrame.unionByName, [r.withColumn("priority", F.lit(i)) for i, r in enumerate(results)])
    rn = F.row_number().over(Window.partitionBy(key).orderBy("priority", *order))
    return tagged.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def repository_filter(df: DataFrame, name: str, stars: str, commits: str, min_stars: int, min_commits: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Repositories with enough stars and commits (null counts as 0) whose name contains no excluded word, in any case."""
    low = F.lower(name)
    for word in exclude:
        df = df.where(~F.coalesce(F.contains(low, F.lit(word.lower())), F.lit(False)))
    return df.where(F.coalesce(F.col(stars), F.lit(0)) >= min_stars).where(F.coalesce(F.col(commits), F.lit(0)) >= min_commits)


def top_by(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the largest ``by``."""
    return df.orderBy(F.desc(by), tie).limit(n)


def status_counts(df: DataFrame, status: Column, failed: str, mined: Column) -> DataFrame:
    """One row: attempted, not failed at the first step, with mined rows."""
    return df.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(~status.eqNullSafe(F.lit(failed))).alias("started"), F.count_if(F.coalesce(mined, F.lit(0)) > 0).alias("with_rows")
    )


def mining_summary(df: DataFrame, name: str, stars: str, status: str, commits: str, parameters: dict[str, object] | None = None, failed: str = "clone_failed") -> DataFrame:
    """One row of a mining run: ``total_repositories_found, total_repositories_attempted, total_repositories_successful_clone,
    total_repositories_commits_mined_at_least_one, total_commits, top_repositories_by_stars, statuses, parameters``.

    The top list holds ten repositories (stars falling, then names; null stars last);
    ``statuses`` counts each status. The row is small whatever the input.
    """
    top = top_by(df.select(F.col(name).alias("repo"), F.coalesce(F.col(stars), F.lit(-1)).alias("stars")), "stars", 10, "repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("stars")).alias("o"), "repo", "stars"))), lambda x: F.struct(x["repo"].alias("repo"), F.nullif(x["stars"], F.lit(-1)).alias("stars"))).alias("top_repositories_by_stars")
    )
    counts = df.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("statuses"))
    totals = df.agg(
        F.count(F.lit(1)).alias("total_repositories_found"), F.count(F.lit(1)).alias("total_repositories_attempted"),
        F.count_if(~F.col(status).eqNullSafe(F.lit(failed))).alias("total_repositories_successful_clone"),
        F.count_if(F.coalesce(F.col(commits), F.lit(0)) > 0).alias("total_repositories_commits_mined_at_least_one"), F.coalesce(F.sum(commits), F.lit(0)).alias("total_commits"),
    )
    given = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(str(v)).alias("value")) for k, v in sorted((parameters or {}).items())]) if parameters else F.array().cast("array<struct<name:string,value:string>>")
    # Three one-row results.
    one = totals.withColumn("__one", F.lit(1)).join(counts.withColumn("__one", F.lit(1)), "__one").join(top.withColumn("__one", F.lit(1)), "__one")
    return one.drop("__one").withColumn("parameters", given)


def processed_repositories(df: DataFrame, name: str, status: str, commits: str, reason: str | None = None) -> DataFrame:
    """``repo, attempts, status, mined_commits``, and ``reason`` if named: the outcome of each repository, whose last status by name order counts, over all its attempts."""
    more = [F.max(reason).alias("reason")] if reason else []
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("repo")).agg(
        F.count(F.lit(1)).alias("attempts"), F.max(status).alias("status"), F.coalesce(F.max(commits), F.lit(0)).alias("mined_commits"), *more
    )


def summary_json(summary: DataFrame) -> DataFrame:
    """One row ``summary``: the mining summary as JSON, parameters as an object."""
    own = F.transform("parameters", lambda x: F.struct(x["name"], x["value"]))
    return summary.withColumn("parameters", F.map_from_entries(own)).select(F.to_json(F.struct(*summary.columns)).alias("summary"))


def repository_urls(repo_name: Column, commit_hash: Column, base: str) -> tuple[Column, Column]:
    """(repository URL, spreadsheet link to the commit) from ``owner_name_hash``.

    Owner and name are the first two parts between underscores, as in the folder names.
    """
    parts = F.split(repo_name, "_", 3)
    url = F.concat(F.lit(base.rstrip("/") + "/"), parts[0], F.lit("/"), F.get(parts, F.lit(1)))
    return url, F.concat(F.lit('=HYPERLINK("'), url, F.lit("/commit/"), commit_hash, F.lit('")'))


# Spellings of definite labels in annotation tables, in upper case.
YES = ("TRUE", "T", "1", "1.0", "YES", "Y", "SIM", "S", "VERDADEIRO", "V", "SÍ", "SI", "VERDADERO")
NO = ("FALSE", "F", "0", "0.0", "NO", "N", "NÃO", "NAO", "FALSO")


def label_value(label: Column) -> Column:
    """True, false, or null for open, blank and unknown labels of an annotation table."""
    t = F.upper(F.regexp_replace(label, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", ""))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)
