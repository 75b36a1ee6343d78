"""A sample whose share of each category matches given target proportions.

Acceptance probabilities come from target-to-observed ratios; each commit decides
on its own by a hash of its key, with slight oversampling, and the counts are then
corrected to the exact number. A category in which oversampling still left too few
rows takes all of its rows into the correction, so the result never falls short of
what is available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import to_instant
from ..lineage import cut
from ..operators.running import running_totals, unit_hash

LONG_MESSAGE = 100


def eligible_commits(mined: DataFrame) -> DataFrame:
    """``commit_hash, year_month, msg_len_category`` of each eligible commit, once.

    Eligible: a non-empty ``commit_hash`` with a non-null message and a date that
    names a real instant. Repeated rows collapse (the earliest instant and the
    smallest message count, should copies of a commit differ); months are in UTC.
    Empty input gives no rows.
    """
    rows = mined.select("commit_hash", to_instant(F.col("date")).alias("ts"), F.length("message").alias("len")).where(
        (F.col("commit_hash") != "") & F.col("len").isNotNull() & F.col("ts").isNotNull()
    )
    one = rows.groupBy("commit_hash").agg(F.min("ts").alias("ts"), F.min("len").alias("len"))
    return one.select(
        "commit_hash", F.date_format("ts", "yyyy-MM").alias("year_month"), F.when(F.col("len") > LONG_MESSAGE, "long").otherwise("short").alias("msg_len_category")
    )


def sample_to_targets(
    items: DataFrame, key: str, categories: list[str], targets: DataFrame, fraction: float = 0.2, oversample: float = 1.1, slack: float = 6.0, seed: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of ``items`` for ``targets``.

    items: one row per ``key`` with the category columns; targets: the category
    columns, ``target_id, target_share, min_rows``. A target wants the larger of
    ``min_rows`` and ceil(share x N) rows, N being floor(fraction x items). Sample:
    ``key``, categories, ``target_id``. Report: one row per target with
    ``wanted, available, drawn, deficit, target_share, drawn_share``.

    Null shares and minima count as 0; targets with a null category match nothing
    and are reported with a deficit; categories without a target give no rows;
    repeated keys count as often as they occur; empty items give an empty sample
    and a report of deficits. Equal hashes are ordered by key, so the same seed draws
    the same rows on any partitioning. Other columns are ignored whatever their names.
    """
    own = targets.select(
        "target_id", *categories, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows")
    )
    items = cut(items.select(key, *categories).withColumn("__u", unit_hash(F.col(key), seed=seed)))
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    observed = items.groupBy(*categories).agg(F.count(F.lit(1)).alias("available"))
    plan = (
        own.join(observed, categories, "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("wanted", F.greatest(F.col("min_rows").cast("bigint"), F.ceil(F.col("target_share") * F.floor(F.lit(fraction) * total))))
        .withColumn("quota", F.least("wanted", "available"))
        .withColumn("__p", F.least(F.lit(1.0), (F.col("quota") * oversample + slack * F.sqrt("quota") + slack) / F.greatest("available", F.lit(1))))
    )
    plan = cut(plan)  # one row per target
    rows = items.join(plan.select("target_id", *categories, "quota", "__p"), categories)
    kept = rows.where(F.col("__u") < F.col("__p")).groupBy("target_id").agg(F.count(F.lit(1)).alias("__kept"))
    short = plan.join(kept, "target_id", "left").select(
        "target_id", F.when(F.coalesce("__kept", F.lit(0)) < F.col("quota"), F.lit(1.0)).otherwise(F.col("__p")).alias("__q")
    )
    accepted = rows.join(short, "target_id").where(F.col("__u") < F.col("__q")).withColumn("__v", F.col("__u") / F.col("__q")).withColumn("__one", F.lit(1))
    ranked = running_totals(accepted, ["target_id"], "__v", "__one", [key], out="__before")
    sample = cut(ranked.where(F.col("__before") < F.col("quota")).select(key, *categories, "target_id"))
    drawn = sample.groupBy("target_id").agg(F.count(F.lit(1)).alias("drawn"))
    all_drawn = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    report = (
        plan.join(drawn, "target_id", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .select(
            "target_id", *categories, "target_share", "wanted", "available", "drawn", (F.col("wanted") - F.col("drawn")).alias("deficit"),
            F.when(all_drawn > 0, F.col("drawn") / all_drawn).alias("drawn_share"),
        )
    )
    return sample, report
