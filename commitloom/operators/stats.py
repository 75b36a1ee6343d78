"""Corpus statistics and data-quality checks, in one pass where possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text


def length_summary(length: Column) -> list[Column]:
    """Mean, median, P10 and P90 with linear interpolation, rounded half to even at two digits."""
    q = F.percentile(length, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    return [F.bround(F.avg(length), 2).alias("msg_len_mean"), F.bround(q[0], 2).alias("msg_len_median"), F.bround(q[1], 2).alias("msg_len_p10"), F.bround(q[2], 2).alias("msg_len_p90")]


def corpus_overview(commits: DataFrame, message: str, repo: str, when: str, unicode: bool = True) -> DataFrame:
    """One row: sizes, dates, message lengths and the numbers of messages with each trait.

    One scan and one partial aggregate a task; the exact percentiles keep a table of
    distinct lengths and not of rows.
    """
    basic = text.clean_basic(F.col(message), unicode)
    rows = commits.withColumn("__basic", basic)
    return rows.agg(
        F.count(F.lit(1)).alias("n_commits"), F.count_distinct(repo).alias("n_repos"), F.min(when).alias("min_date"), F.max(when).alias("max_date"),
        *length_summary(F.length("__basic")),
        F.count_if(text.has_url(F.col(message))).alias("n_urls"), F.count_if(text.has_issue_ref(F.col(message))).alias("n_issue_refs"), F.count_if(text.has_emoji(F.col(message))).alias("n_emojis"),
        F.count_if(text.has_prefix(F.col("__basic"), "fix")).alias("n_fix"), F.count_if(text.has_prefix(F.col("__basic"), "feat")).alias("n_feat"),
    )


def commit_traits(commits: DataFrame) -> DataFrame:
    """One row: ``n_commits, n_generic_merges, n_only_vendor, n_touch_vendor, n_non_english`` of summarised commits.

    Messages without letters have no language.
    """
    line = text.first_line(F.col("msg_original"))
    return commits.agg(
        F.count(F.lit(1)).alias("n_commits"), F.count_if("is_merge").alias("n_generic_merges"), F.count_if("only_vendor").alias("n_only_vendor"), F.count_if("touches_vendor").alias("n_touch_vendor"),
        F.count_if(line.rlike(r"\p{L}") & (text.language(line) != "en")).alias("n_non_english"),
    )


def extension_counts(records: DataFrame, commit: list[str], file: str) -> DataFrame:
    """``ext, n_commits``: commits (by their key columns) that touch each extension; files without one are left out.

    Counted as distinct (commit, extension) first, so no commit's files meet.
    """
    pairs = records.where(F.col(file).isNotNull()).select(*commit, paths.extension(F.col(file)).alias("ext")).where("ext <> ''").distinct()
    return pairs.groupBy("ext").agg(F.count(F.lit(1)).alias("n_commits"))


def shares(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``name, n, share`` of each value of ``key``; null keys are left out."""
    counts = df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def drift(a: DataFrame, b: DataFrame, name: str, alert: float = 0.1) -> DataFrame:
    """One row: the largest difference of two distributions, if they have equally many values, and whether it is an alert."""
    both = a.select(name, F.col("share").alias("sa")).join(b.select(name, F.col("share").alias("sb")), name, "full_outer")
    d = F.max(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))))
    same = F.count("sa") == F.count("sb")
    return both.agg(F.when(same, d).alias("max_drift"), F.coalesce(same & (d > alert), F.lit(False)).alias("alert"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """``label, n, share`` of every cluster, noise (-1) included."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def cluster_summary(df: DataFrame, label: str) -> DataFrame:
    """One row: clusters without noise, noise rows, all rows and the share of noise."""
    return df.agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters"), F.count_if(F.col(label) == -1).alias("n_noise"), F.count(F.lit(1)).alias("n_rows"),
        (F.count_if(F.col(label) == -1) / F.count(F.lit(1))).alias("noise_share"),
    )


def validate(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``check, value, ok``: aggregates named by ``checks`` with the condition each has to meet (on a column called ``value``)."""
    one = df.agg(*[v.cast("double").alias(k) for k, (v, _) in checks.items()])
    rows = [one.select(F.lit(k).alias("check"), F.col(k).alias("value")).withColumn("ok", F.coalesce(cond, F.lit(False))) for k, (_, cond) in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def corpus_checks(commits: DataFrame, sample: DataFrame, when: str, length: Column, size: int, at_least: int = 50, drift_alert: float = 0.1, median_alert: float = 0.2) -> DataFrame:
    """``check, value, ok``: a sample against its corpus.

    ``sample_rows`` (within a tenth of ``size``), ``thin_months`` (months of the sample
    with fewer than ``at_least`` rows), ``yearly_drift`` (largest difference of the
    shares of years; not ok if they differ in number), ``median_drift`` (of ``length``,
    as a share of the corpus' median, both sides in one unit), ``undated`` (share of
    rows without a date in the corpus).
    """
    month = sample.where(F.col(when).isNotNull()).groupBy(F.date_format(when, "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    thin = month.agg(F.count_if(F.col("n") < at_least).cast("double").alias("value")).select(F.lit("thin_months").alias("check"), "value", (F.col("value") == 0).alias("ok"))
    rows = sample.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("sample_rows").alias("check"), "value", F.col("value").between(0.9 * size, 1.1 * size).alias("ok"))
    years = drift(shares(commits, F.year(when), "y"), shares(sample, F.year(when), "y"), "y", drift_alert)
    years = years.select(F.lit("yearly_drift").alias("check"), F.col("max_drift").cast("double").alias("value"), (F.col("max_drift").isNotNull() & ~F.col("alert")).alias("ok"))
    middle = lambda df: df.agg(F.median(length).alias("m")).scalar()
    median = commits.agg((F.abs(F.median(length) - middle(sample)) / F.nullif(F.median(length), F.lit(0.0))).alias("value"))
    median = median.select(F.lit("median_drift").alias("check"), "value", F.coalesce(F.col("value") <= median_alert, F.lit(False)).alias("ok"))
    undated = validate(commits, {"undated": (F.count_if(F.col(when).isNull()) / F.count(F.lit(1)), F.col("value") < 0.05)})
    return reduce(DataFrame.unionByName, [rows, thin, years, median, undated])


def recount(df: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    """``check, value, ok``: keys whose count in ``counts`` differs from that of ``df``, in either direction."""
    own = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = own.join(counts.select(F.col(key).alias("__k"), F.col(n).alias("__c")), F.col(key).eqNullSafe(F.col("__k")), "full_outer")
    return both.agg(F.count_if(~F.col("__n").eqNullSafe(F.col("__c"))).cast("double").alias("value")).select(F.lit("recount_" + key).alias("check"), "value", (F.col("value") == 0).alias("ok"))
