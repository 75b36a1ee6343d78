"""Running totals within groups of any size, without a group's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed only."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def running_totals(df: DataFrame, group: list[str], u: str, weight: str, tie: list[str], out: str = "before", buckets: int = 1024) -> DataFrame:
    """``df`` with ``out``: the weight of the group's rows that come earlier by (``u``, ``tie``).

    ``u`` lies in [0, 1) and spreads evenly (see :func:`unit_hash`), so it cuts each
    group into ``buckets`` ranges of about equal size. Sums of ranges are added up
    first (at most ``buckets`` rows a group), then rows within each range. The rows
    are shuffled once, by (group, range): a hot group is split like any other data.
    """
    w = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__b", F.floor(F.col(u) * buckets).cast("int"))
    ranges = df.groupBy(*group, "__b").agg(F.sum(weight).alias("__w")).withColumn("__base", F.coalesce(F.sum("__w").over(w), F.lit(0)))
    keys = [*group, "__b"]
    ranges = ranges.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)], "__base")
    cond = F.lit(True)
    for i, c in enumerate(keys):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    joined = df.join(ranges, cond).drop(*[f"__r{i}" for i in range(len(keys))])
    inner = Window.partitionBy(*group, "__b").orderBy(u, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, (F.col("__base") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))).drop("__b", "__base")
