"""Deterministic samples: the order of a hash of the key replaces a random generator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int = 42) -> Column:
    """A number-like text that orders rows at random, the same on any engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows at random (all if there are fewer): a distributed top-n."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: Column, target: int, seed: int = 42) -> DataFrame:
    """At most ceil(target / strata) rows of each stratum; rows with a null stratum are left out.

    The number of strata is a scalar; ranks are needed up to the quota only, so the
    optimizer limits each stratum while it sorts (window group limit).
    """
    rows = df.withColumn("stratum", stratum).where(F.col("stratum").isNotNull())
    quota = rows.agg(F.ceil(F.lit(target) / F.count_distinct("stratum")).alias("k")).first().k or 0
    rn = F.row_number().over(Window.partitionBy("stratum").orderBy(draw(F.col(key), seed), key))
    return rows.withColumn("__rn", rn).where(F.col("__rn") <= int(quota)).drop("__rn")


def quota_sample(df: DataFrame, key: str, stratum: Column, length: Column, target: int, at_least: int = 50, seed: int = 42) -> DataFrame:
    """A sample by stratum and length category with quotas and random fill: ``key, stratum, category``.

    A stratum of fewer than ``at_least`` rows gives all of them, others the larger of
    ``at_least`` and ceil(target / strata); half of the quota (rounded up) goes to each
    length category (``long`` is above the median). Early strata come first until
    ``target`` rows are drawn; the rest is filled at random. With one stratum, or
    fewer rows than a tenth of the target, it is a simple sample.
    """
    rows = df.select(F.col(key).alias(key), stratum.alias("stratum"), length.alias("len")).where(F.col("stratum").isNotNull())
    facts = rows.agg(F.median("len").alias("med"), F.count_distinct("stratum").alias("months"), F.count(F.lit(1)).alias("n")).first()
    rows = rows.withColumn("category", F.when(F.col("len") > F.lit(facts.med), "long").otherwise("short"))
    if facts.months <= 1 or facts.n < target / 10:
        return simple_sample(rows, key, target, seed).select(key, "stratum", "category")
    size = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    size = size.withColumn("quota", F.least("n", F.when(F.col("n") < at_least, F.col("n")).otherwise(max(at_least, math.ceil(target / facts.months)))))
    order = [draw(F.col(key), seed), F.col(key)]
    short_first = F.when(F.col("category") == "short", 0).otherwise(1)
    ranked = rows.join(size.select("stratum", "quota"), "stratum").withColumn("rn", F.row_number().over(Window.partitionBy("stratum", "category").orderBy(*order)))
    strata = ranked.where(F.col("rn") <= F.ceil(F.col("quota") / 2))
    # At most the quotas' rows reach this sort.
    first = strata.orderBy("stratum", short_first, "rn").limit(target).select(key, "stratum", "category")
    rest = rows.join(first.select(key), key, "left_anti")
    missing = max(0, target - first.count())
    return first.unionByName(rest.orderBy(*order).limit(missing).select(key, "stratum", "category"))


def annotator_split(df: DataFrame, key: str, annotators: list[str], shared: int, seed: int = 42) -> DataFrame:
    """``annotator`` and the rows of a sample: the first ``shared`` rows go to everyone, the rest is dealt in equal parts.

    df is a sample that people will read, so its rank window is small.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(draw(F.col(key), seed), key)
    rows = df.withColumn("__rn", F.row_number().over(w))
    everyone = rows.where(F.col("__rn") <= shared).withColumn("annotator", F.explode(F.array(*[F.lit(a) for a in annotators])))
    part = F.ntile(len(annotators)).over(Window.partitionBy(F.lit(0)).orderBy("__rn"))
    own = rows.where(F.col("__rn") > shared).withColumn("annotator", F.element_at(F.array(*[F.lit(a) for a in annotators]), part))
    return everyone.unionByName(own).drop("__rn")
