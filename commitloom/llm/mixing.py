"""Mixing sources to target weights.

A splitting tree divides exact block quotas of the sources among output shards: at
every node the blocks are dealt to the two halves by a multivariate hypergeometric
draw, so each shard gets a random share of each source and the sums stay exact. The
driver splits the top of the tree only; the subtrees below are split by tasks.
Every source's documents are permuted by hash and cut into disjoint blocks of that
order; a shard receives whole blocks and shuffles its documents locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import token_count
from ..lineage import cut
from ..operators.running import running_totals, unit_hash


#: Nodes of the tree that the driver splits before tasks take over.
TOP = 256


def descend(node: tuple, seed: int, largest: int) -> Iterator[tuple]:
    """Nodes of at most ``largest`` shards below a node (first shard, end, blocks of each source, blocks of each source in earlier shards).

    A node over k shards gives its left half, of k // 2 shards, its part of all blocks
    by a multivariate hypergeometric draw, whose seed is the node's place only.
    """
    stack = [node]
    while stack:
        lo, hi, have, before = stack.pop()
        if hi - lo <= largest:
            yield lo, hi, have, before
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = round(total * (mid - lo) / (hi - lo))
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have * 0
        stack += [(mid, hi, have - left, before + left), (lo, mid, left, before)]


def split_quotas(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns add up to ``blocks``. Zero sources or shards work."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    if shards and blocks:
        have = np.asarray(blocks, dtype=np.int64)
        for lo, _, dealt, _ in descend((0, shards, have, have * 0), seed, 1):
            out[lo] = dealt
    return out


def dealt_blocks(spark: SparkSession, sources: list[str], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """``source, shard, lo, hi``: the range of each source's blocks that each shard gets, from subtrees split in parallel."""
    have = np.asarray(blocks, dtype=np.int64)
    top = descend((0, shards, have, have * 0), seed, -(-shards // TOP)) if sources else []
    nodes = [(lo, hi, own.tolist(), before.tolist()) for lo, hi, own, before in top]  # at most 2 x TOP

    def leaves(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for lo, hi, own, before in zip(pdf["lo"], pdf["hi"], pdf["have"], pdf["before"]):
                for shard, _, dealt, start in descend((lo, hi, np.asarray(own, dtype=np.int64), np.asarray(before, dtype=np.int64)), seed, 1):
                    at = np.flatnonzero(dealt)
                    if len(at):
                        yield pd.DataFrame({"source": [sources[i] for i in at], "shard": shard, "lo": start[at], "hi": start[at] + dealt[at] - 1})

    frame = spark.createDataFrame(nodes, "lo int, hi int, have array<bigint>, before array<bigint>")
    return frame.repartition(max(1, min(len(nodes), TOP // 8))).mapInPandas(leaves, "source string, shard int, lo bigint, hi bigint")


def mix_sources(
    documents: DataFrame, targets: DataFrame, fraction: float = 0.5, shard_tokens: int = 1_000_000, blocks_per_shard: int = 64, seed: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of ``documents`` for the weights of ``targets``.

    documents: ``doc_id, text, source``; targets: ``source, target_weight,
    max_repeats``, a table of bounded size (its rows are collected). B is
    ``fraction`` of the tokens of all documents, those of other sources included. A source
    gives weight x B tokens, or all its tokens ``max_repeats`` times if that is less;
    it runs through its documents in a fixed random order, again from the start when
    needed, and ends with the document nearest to the quota. Mix: ``source, doc_id,
    copy_no, n_tokens, shard, slot``. Report, one row per target: ``source,
    target_weight, tokens, max_repeats, quota, drawn, share, max_copies, short``; a
    source is short if the shards hold all its permitted copies and those are fewer
    tokens than it should give.

    Documents without a source or target are left out (their tokens count in B); null weights count as 0, null repeats as 1; targets whose source has no
    documents are reported as short unless their weight is 0; documents without text
    have 0 tokens and come along at no cost; repeated ``doc_id`` are separate rows;
    empty documents or targets give an empty mix. Texts of any length are counted
    whole; other columns are ignored whatever their names.
    """
    docs = cut(documents.select("source", "doc_id", token_count(F.col("text")).alias("n_tokens")).withColumn("__u", unit_hash(F.col("doc_id"), F.col("source"), seed=seed)))
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    budget = docs.agg((F.coalesce(F.sum("n_tokens"), F.lit(0)) * fraction).alias("b")).scalar()
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.coalesce(F.max("target_weight"), F.lit(0.0)).alias("target_weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    plan = want.join(sums, "source", "left").select(
        "source", "target_weight", "max_repeats", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), (F.col("target_weight") * budget).alias("wanted")
    )
    plan = cut(plan.withColumn("quota", F.least(F.col("wanted"), (F.col("tokens") * F.col("max_repeats")).cast("double"))))

    rows = plan.select("source", "quota").orderBy("source").collect()  # one per target
    shards = max(1, math.ceil(sum(r.quota for r in rows) / shard_tokens))
    block = max(1.0, sum(r.quota for r in rows) / (shards * blocks_per_shard))
    where = dealt_blocks(documents.sparkSession, [r.source for r in rows], [math.ceil(r.quota / block) for r in rows], shards, seed)
    where = where.select("source", "shard", F.explode(F.sequence("lo", "hi")).alias("block"))

    docs = docs.join(plan.select("source", "tokens", "quota", "max_repeats"), "source")
    placed = running_totals(docs, ["source"], "__u", "n_tokens", ["doc_id"], out="before")
    full = F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))
    rest = F.col("quota") - full * F.col("tokens")
    copies = F.least(F.col("max_repeats"), full + (F.col("before") + F.col("n_tokens") / 2 <= rest).cast("int")).cast("int")
    placed = placed.withColumn("copies", F.when(F.col("quota") > 0, copies).otherwise(0)).where("copies > 0")
    copy = placed.select("source", "doc_id", "n_tokens", "quota", F.posexplode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy_no", "__x"), "before", "tokens")
    copy = copy.withColumn("block", F.least(F.floor((F.col("copy_no") * F.col("tokens") + F.col("before")) / block), F.ceil(F.col("quota") / block) - 1))
    mix = copy.join(where, ["source", "block"]).withColumn("__o", F.xxhash64(F.lit(seed), "shard", "source", "doc_id", "copy_no"))
    mix = cut(mix.select("source", "doc_id", "copy_no", "n_tokens", "shard", F.row_number().over(Window.partitionBy("shard").orderBy("__o", "source", "doc_id", "copy_no")).alias("slot")))

    drawn = mix.groupBy("source").agg(F.sum("n_tokens").alias("drawn"), (F.max("copy_no") + 1).alias("max_copies"))
    all_drawn = mix.agg(F.sum("n_tokens").alias("n")).scalar()
    got = plan.join(drawn, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    exhausted = F.col("drawn") == F.col("tokens") * F.col("max_repeats")
    report = got.select(
        "source", "target_weight", "tokens", "max_repeats", "quota", "drawn",
        F.coalesce(F.col("drawn") / all_drawn, F.lit(0.0)).alias("share"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"), (exhausted & (F.col("drawn") < F.col("wanted"))).alias("short"),
    )
    return mix, report
