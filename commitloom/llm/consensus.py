"""Consensus labels, agreement and reliability of annotators who disagree.

Labels are edges of a bipartite graph of items and annotators. An item tells each of
its annotators what the others make it believe; an annotator tells each item how
reliable the rest of their labels make them. Messages leave out what their receiver
said, and run until they stand still. A class is decided against the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.records import label_value

#: Prior of an annotator's reliability, as labels they had right and wrong before.
RIGHT, WRONG = 4.0, 1.0
TOLERANCE = 1e-3
#: From this round on, messages move part of the way only, a smaller one in each round, so that they stop even where they would swing for ever.
DAMPED_FROM = 20


def definite(label: Column) -> Column:
    """``yes``, ``no``, or null for open, blank and unknown spellings."""
    value = label_value(label)
    return F.when(value, "yes").when(~value, "no")


def commit_refs(tables: dict[str, DataFrame]) -> DataFrame:
    """``annotator, ref, repo_path, label`` of each row with a commit hash (7 to 40 digits) in its URL and a definite label."""
    parts = []
    for name, df in tables.items():
        url = F.lower("commit_URL")
        parts.append(
            df.select(
                F.lit(name).alias("annotator"), F.regexp_extract(url, r"/commits?/([0-9a-f]{7,40})(?![0-9a-f])", 1).alias("ref"),
                F.regexp_extract(url, r"([\w.-]+/[\w.-]+)/commits?/", 1).alias("repo_path"), definite(F.col("is_bugfix")).alias("label"),
            )
        )
    return reduce(DataFrame.unionByName, parts).where((F.col("ref") != "") & F.col("label").isNotNull())


def resolve_commits(refs: DataFrame, mined: DataFrame) -> DataFrame:
    """``annotator, item, label``: full hashes as they are, shortened ones completed from the mined commits.

    A shortened hash that fits several commits is settled by the repository in the
    URL; one that fits none, or still several, is dropped.
    """
    full = refs.where(F.length("ref") == 40).select("annotator", F.col("ref").alias("item"), "label")
    short = refs.where(F.length("ref") < 40).withColumn("__s", F.substring("ref", 1, 7))
    own = F.lower(F.replace(F.regexp_replace("repo", "_[0-9a-f]{8}$", ""), F.lit("_"), F.lit("/")))
    commits = mined.where(F.col("commit_hash") != "").select(F.lower("commit_hash").alias("item"), own.alias("own"))
    commits = commits.withColumn("__s", F.substring("item", 1, 7)).join(short.select("__s").distinct(), "__s", "left_semi").distinct()
    fits = short.join(commits, "__s").where(F.col("item").startswith(F.col("ref")))
    one = fits.groupBy("annotator", "ref", "repo_path", "label").agg(
        F.collect_set("item").alias("all"), F.collect_set(F.when(F.replace("own", F.lit("/"), F.lit("_")) == F.replace("repo_path", F.lit("/"), F.lit("_")), F.col("item"))).alias("same")
    )
    item = F.when(F.size("all") == 1, F.col("all")[0]).when(F.size("same") == 1, F.col("same")[0])
    return full.unionByName(one.select("annotator", item.alias("item"), "label").where(F.col("item").isNotNull()))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def one_against_rest(labels: DataFrame, positive: str) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) for the class ``positive`` against all other labels.

    labels: one row per (item, annotator) with ``label``. Items: ``item, n_labels,
    belief`` (probability of the class). Annotators: ``annotator, reliability,
    n_labels``: how often they are right, from the items that others labelled too
    (the prior's mean for those without); ``rounds`` and ``damped`` (whether the messages
    only stood still as their steps became smaller). An item of one label only gets its
    belief at the end and moves no message. Empty labels give empty results.
    """
    per_item = Window.partitionBy("item")
    sign = F.when(F.col("label") == positive, 1).otherwise(-1)
    edges = labels.select("item", "annotator", sign.alias("a")).repartition("item").withColumn("k", F.count(F.lit(1)).over(per_item))
    edges = cut(edges.withColumn("x", F.lit(0.0)).withColumn("p", F.lit(RIGHT / (RIGHT + WRONG))))
    start = edges.agg(((F.count_if(F.col("a") > 0) + 1) / (F.count(F.lit(1)) + 2)).alias("share")).first()
    share = float(start.share)
    alone = F.col("k") == 1

    def heard(e: DataFrame, pi: float) -> DataFrame:
        """Items' messages: the belief in the class, as a number from -1 to 1, without the receiver's label."""
        w = F.col("a") * _logit(F.col("p"))
        total = F.sum(w).over(per_item) + F.log(F.lit(pi / (1 - pi)))
        return e.withColumn("total", total).withColumn("next", F.tanh((F.col("total") - w) / 2))

    # How likely a label is right, from what the others say and how reliable its annotator is.
    fits = (1 + F.col("a") * F.col("next")) / 2
    right = F.col("p") * fits / (F.col("p") * fits + (1 - F.col("p")) * (1 - fits))

    rounds = 0
    while True:
        rounds += 1
        # A step of 1 / (k + 1) at the k-th damped round: steps whose sum has no bound, but whose size goes to nothing.
        step = 1.0 / max(1, rounds - DAMPED_FROM + 1)
        e = heard(edges, share).withColumn("next", F.col("x") + step * (F.col("next") - F.col("x")))
        e = cut(e.select("item", "annotator", "a", "k", "p", "x", "next", "total"))
        stats = e.agg(F.max(F.when(~alone, F.abs(F.col("next") - F.col("x")))).alias("moved"), F.avg(F.when(~alone, 1 / (1 + F.exp(-F.col("total")))) / F.col("k")).alias("mass"), F.avg(F.when(~alone, 1 / F.col("k"))).alias("items")).first()
        sums = e.where(~alone).groupBy("annotator").agg(F.sum(right).alias("s"), F.count(F.lit(1)).alias("n"))
        own = F.when(alone, F.lit(0.0)).otherwise(right)
        s, n = F.coalesce("s", F.lit(0.0)), F.coalesce("n", F.lit(0)) - F.when(alone, 0).otherwise(1)
        p = (RIGHT + s - own) / (RIGHT + WRONG + n)
        edges = e.join(sums, "annotator", "left").select("item", "annotator", "a", "k", F.col("next").alias("x"), F.greatest(F.lit(0.02), F.least(F.lit(0.98), p)).alias("p"))
        if stats.items:
            share = min(0.98, max(0.02, stats.mass / stats.items))
        if stats.moved is None or stats.moved < TOLERANCE:
            break
    edges = cut(heard(edges, share))
    items = edges.groupBy("item").agg(F.max("k").alias("n_labels"), F.max(1 / (1 + F.exp(-F.col("total")))).alias("belief"))
    annotators = edges.groupBy("annotator").agg(
        ((RIGHT + F.coalesce(F.sum(F.when(~alone, right)), F.lit(0.0))) / (RIGHT + WRONG + F.count_if(~alone))).alias("reliability"), F.count(F.lit(1)).alias("n_labels"),
        F.lit(rounds).alias("rounds"), F.lit(rounds > DAMPED_FROM).alias("damped"),
    )
    return items, annotators


def consensus(labels: DataFrame, classes: tuple[str, ...] = ("yes", "no")) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of ``labels`` (``item, annotator, label``).

    Items: ``item, consensus, confidence, n_labels, agreement`` (share of pairs of its
    annotators who agree, null for one). Annotators: ``annotator, reliability,
    n_labels, rounds, damped``, averaged over the classes (the most rounds of any). Two classes mirror each other, so the first
    decides; of more, the one with the highest belief wins, the earlier one on a tie.
    An item of one label keeps it, with the confidence that its annotator deserves. Null items, annotators and labels and labels of other classes are left out;
    repeated rows count once; if an annotator's labels of an item differ, the smallest
    counts; an empty table gives empty results. Other columns are ignored whatever
    their names.
    """
    clean = labels.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isin(*classes))
    one = cut(clean.groupBy("item", "annotator").agg(F.min("label").alias("label")))
    counts = one.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("item").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("n"), F.min("label").alias("only"))
    agreement = counts.select("item", F.when(F.col("n") == 1, F.col("only")).alias("only"), F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("agreement"))
    tried = [(c, *one_against_rest(one, c)) for c in (classes[:1] if len(classes) == 2 else classes)]
    if len(classes) == 2:
        c, items, annotators = tried[0]
        items = items.join(agreement.select("item", "only"), "item")
        yes = F.when(F.col("only").isNotNull(), F.col("only") == c).otherwise(F.col("belief") > 0.5)
        items = items.select("item", "n_labels", F.when(yes, c).otherwise(classes[1]).alias("consensus"), F.when(yes, F.col("belief")).otherwise(1 - F.col("belief")).alias("confidence"))
    else:
        rows = reduce(DataFrame.unionByName, [i.withColumn("c", F.lit(c)).withColumn("o", F.lit(-k)) for k, (c, i, _) in enumerate(tried)])
        items = rows.groupBy("item").agg(F.max("n_labels").alias("n_labels"), F.max_by("c", F.struct("belief", "o")).alias("consensus"), F.max("belief").alias("confidence"))
        annotators = reduce(DataFrame.unionByName, [a for _, _, a in tried]).groupBy("annotator").agg(F.avg("reliability").alias("reliability"), F.max("n_labels").alias("n_labels"), F.max("rounds").alias("rounds"), F.max("damped").alias("damped"))
    return items.join(agreement, "item").select("item", F.coalesce("only", "consensus").alias("consensus"), "confidence", "n_labels", "agreement"), annotators
