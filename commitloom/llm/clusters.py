"""Clusters of commits whose messages are the same text apart from small edits.

Messages become sets of word bigrams without layout, case, numbers and the lines that
tools add, so most copies collapse before anything is compared. The remaining forms
are clustered by parallel pivot correlation clustering. Forms are ordered by hash. In
every bucket of forms that share one of their rarest bigrams (a prefix filter for the
threshold), each form is compared with the bucket's lowest form only, never with all.
A form without a similar lower one is a pivot; pivots absorb their similar forms, the
closest pivot wins, and the rest goes into the next round. Pivots then meet each other
in the same way. Those that remain meet all forms of their buckets, so that no similar
form stays apart because others hide it. A bucket with many of them is not paired up:
it is split by the sizes of both forms, which shortens the prefixes, and then by further
shared bigrams, until its parts are small. Members move to the closest medoid, and medoids
are computed again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Jaccard similarity of word bigrams from which two messages are the same but for small
#: edits. Edited copies of a message of 12 words or more keep at least this share even when
#: several words change; messages that only share a pattern of wording stay below half of it.
SIMILARITY = 0.35
#: Buckets of the frequency table that orders bigrams; a fixed size, whatever the corpus.
TABLE = 1 << 18
#: A bucket with more forms that no pivot absorbs is split before its forms meet.
SPLIT = 128
#: Members of a cluster that meet at once when its pairs are listed.
BLOCK = 1000

# Lines that tools add to messages.
_TOOL_LINES = re.compile(
    r"(?im)^[ \t]*(?:[a-z]+(?:-[a-z]+)*-by:.*|change-id:.*|git-svn-id:.*|merge (?:pull request|branch|remote-tracking branch|tag|commit)\b.*|\(cherry picked from .*|(?:refs?|fix(?:es)?|closes?|see):? #?\d+)[ \t\r]*$"
)


def normal_form(message: str) -> tuple[str, ...]:
    """The words of a message in order: lower case, letters only, without tools' lines and links.

    A message that consists of such lines only keeps them.
    """
    text = re.sub(r"https?://\S+", " ", _TOOL_LINES.sub("", message))
    words = tuple(re.findall(r"[^\W\d_]+", text.lower()))
    return words or tuple(re.findall(r"\w+", message.lower()))


def bigrams(words: tuple[str, ...]) -> list[int]:
    """Sorted distinct hashes of the pairs of neighbouring words (of the only word, if there is one)."""
    pairs = zip(words, words[1:]) if len(words) > 1 else [words]
    return sorted({xxhash.xxh64_intdigest(" ".join(p)) >> 33 for p in pairs if p})


def _forms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch, one row a commit; the bigrams come with the batch's first commit of each form."""
    for pdf in it:
        pdf = pdf.drop_duplicates("commit_hash")
        forms, grams, seen = [], [], set()
        for m in pdf["message"]:
            words = normal_form(m)
            form = xxhash.xxh64_intdigest(" ".join(words)) >> 1
            forms.append(form)
            grams.append(None if form in seen else bigrams(words))
            seen.add(form)
        yield pd.DataFrame({"commit_hash": pdf["commit_hash"], "n_chars": pdf["message"].str.len(), "form": forms, "grams": grams})


def message_forms(mined: DataFrame) -> DataFrame:
    """``commit_hash, n_chars, form, grams`` of the commits with a message; may repeat a commit, and has ``grams`` for some row of each form."""
    rows = mined.where((F.col("commit_hash") != "") & (F.col("message") != "")).select("commit_hash", "message")
    return rows.mapInPandas(_forms, "commit_hash string, n_chars bigint, form bigint, grams array<int>")


def frequency_table(forms: DataFrame) -> np.ndarray:
    """Forms in which the bigrams of each of TABLE hash buckets occur, 0 for those of one form."""
    counted = forms.select(F.explode("grams").alias("g")).groupBy((F.col("g") % TABLE).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    table = np.zeros(TABLE, dtype=np.int64)
    for r in counted.where("n > 1").toLocalIterator():  # at most TABLE rows
        table[r.b] = r.n
    return table


def _flat(grams: pd.Series, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, bigrams, row of each, bigrams with the rarest of each row first) of arrays that are not empty."""
    sizes = grams.str.len().to_numpy()
    flat = np.concatenate([np.asarray(g, dtype=np.int64) for g in grams])
    row = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, flat, row, flat[np.lexsort((flat, table[flat % TABLE], row))]


def prefixes(forms: DataFrame, threshold: float, table: np.ndarray) -> DataFrame:
    """``form, gram, n, sig``: of each form the rarest bigrams, at least one of which every form of ``threshold`` similarity shares.

    ``n`` is the number of the form's bigrams, ``sig`` has a bit for each (bigrams modulo 64).
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            sizes, grams, row, ordered = _flat(pdf["grams"], table)
            rank = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            take = rank < np.minimum(keep, sizes)[row]
            sig = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (grams % 64).astype(np.uint64)), np.cumsum(sizes) - sizes).view(np.int64)
            at = row[take]
            yield pd.DataFrame({"form": pdf["form"].to_numpy()[at], "gram": ordered[take].astype(np.int32), "n": sizes[at].astype(np.int32), "sig": sig[at]})

    return forms.where(F.size("grams") > 0).select("form", "grams").mapInPandas(run, "form bigint, gram int, n int, sig bigint")


def _ordered(forms: DataFrame, table: np.ndarray) -> DataFrame:
    """``form, ordered``: bigrams with the rarest first, in the order of :func:`prefixes`."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                sizes, _, _, ordered = _flat(pdf["grams"], table)
                yield pd.DataFrame({"form": pdf["form"], "ordered": np.split(ordered, np.cumsum(sizes)[:-1])})

    return forms.where(F.size("grams") > 0).select("form", "grams").mapInPandas(run, "form bigint, ordered array<int>")


def _edges(posts: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """``form, low, sim``: each form of ``posts`` with the lower forms it meets as the lowest of a shared bucket, where similar."""
    lows = posts.groupBy("gram").agg(F.min("form").alias("low"), F.max("form").alias("top")).where("low < top").drop("top")
    shapes = posts.groupBy(F.col("form").alias("low")).agg(F.first("n").alias("low_n"), F.first("sig").alias("low_sig"))
    met = posts.join(lows.join(shapes, "low"), "gram").where("form > low")
    return _verified(_possible(met, threshold).select("form", "low").distinct(), forms, threshold)


def _late_edges(posts: DataFrame, links: DataFrame, forms: DataFrame, threshold: float, table: np.ndarray, split: int = SPLIT) -> DataFrame:
    """``form, low, sim``: every form of ``posts`` with the similar forms among those that ``links`` absorbs not; each pair of the latter once.

    No form meets more than ``split`` others in a bucket or part of one.
    """
    marked = posts.join(links.select("form").distinct().withColumn("absorbed", F.lit(True)), "form", "left")
    free = marked.where("absorbed IS NULL")
    hot = cut(free.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > split).select("gram"))
    crowded = not hot.isEmpty()
    if crowded:
        marked = cut(marked)
        free = marked.where("absorbed IS NULL")
    once = "form > low OR absorbed"
    met = _meet(marked, free.join(hot, "gram", "left_anti") if crowded else free, ["gram"], ["gram"], threshold).where(once)
    if crowded:
        met = met.union(_split_meetings(marked.join(hot, "gram", "left_semi"), forms, threshold, table, split).where(once))
    return _verified(met.select("form", "low").distinct(), forms, threshold)


def _meet(rows: DataFrame, free: DataFrame, key: list[str], other: list[str], threshold: float) -> DataFrame:
    """``form, low, absorbed`` of rows and free rows of one bucket that their signatures leave possible; ``other`` names the free rows' key."""
    lows = free.select(*[F.col(b).alias(f"__{a}") for a, b in zip(key, other)], F.col("form").alias("low"), F.col("n").alias("low_n"), F.col("sig").alias("low_sig"))
    met = rows.join(lows, [F.col(a) == F.col(f"__{a}") for a in key]).where("form <> low")
    return _possible(met, threshold).select("form", "low", "absorbed")


def _split_meetings(rows: DataFrame, forms: DataFrame, threshold: float, table: np.ndarray, split: int) -> DataFrame:
    """``form, low, absorbed``: what :func:`_meet` gives for crowded buckets, without pairs that share too little.

    Two forms of n and m bigrams are similar only if they share ``need`` of them, and
    then their first k shared ones lie among the first n - need + k of either. So a
    bucket is split by (n, m), where many bigrams leave the prefix, and the parts that
    are still crowded by the second shared bigram, the third, and so on. Forms that
    share ``need`` bigrams are similar in any case, so those meet the lowest one only.
    """
    ordered = _ordered(forms.join(rows.select("form").distinct(), "form", "left_semi"), table)
    sizes = F.sequence(F.ceil(threshold * F.col("n") - 1e-9), F.floor(F.col("n") / threshold + 1e-9))
    parts = rows.join(ordered, "form").withColumn("rank", F.array_position("ordered", F.col("gram")).cast("int")).withColumn("m", F.explode(sizes)).withColumn("m", F.col("m").cast("int"))
    parts = parts.withColumn("need", F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9).cast("int"))
    parts = parts.where(F.col("rank") <= F.col("n") - F.col("need") + 1).select("form", "absorbed", "n", "m", "sig", "need", "rank", "ordered", F.col("gram").cast("bigint").alias("chain"))
    found, k, key = None, 1, ["chain", "n", "m"]
    while True:
        parts = cut(parts)
        free = parts.where("absorbed IS NULL")
        crowd = cut(free.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > split).drop("c"))
        met = _meet(parts, free.join(crowd, key, "left_anti"), key, ["chain", "m", "n"], threshold)
        found = met if found is None else found.union(met)
        if crowd.isEmpty():
            return found
        # Rows of both sides of a crowded part; n and m change places between the sides.
        sides = crowd.union(crowd.select("chain", F.col("m").alias("n"), F.col("n").alias("m"))).distinct()
        parts = parts.join(sides, key, "left_semi")
        alike = parts.where(F.col("need") <= k)
        lowest = alike.where("absorbed IS NULL").groupBy("chain", F.col("n").alias("m"), F.col("m").alias("n")).agg(F.min("form").alias("low"))
        found = found.union(alike.join(lowest, key).where("form <> low").select("form", "low", "absorbed"))
        k += 1
        following = F.slice("ordered", F.col("rank") + 1, F.greatest(F.col("n") - F.col("need") + k - F.col("rank"), F.lit(0)))
        parts = parts.where(F.col("need") >= k).select("form", "absorbed", "n", "m", "sig", "need", "ordered", "chain", F.col("rank").alias("r"), F.posexplode(following).alias("i", "gram"))
        parts = parts.select("form", "absorbed", "n", "m", "sig", "need", (F.col("r") + F.col("i") + 1).alias("rank"), "ordered", F.xxhash64("chain", "gram").alias("chain"))


def _possible(met: DataFrame, threshold: float) -> DataFrame:
    """Those of ``form, n, sig, low, low_n, low_sig`` that can be similar: each bit that only one side has is a bigram that the sides don't share."""
    most = F.least(F.col("n") - F.bit_count(F.col("sig").bitwiseAND(F.bitwise_not("low_sig"))), F.col("low_n") - F.bit_count(F.col("low_sig").bitwiseAND(F.bitwise_not("sig"))))
    return met.where(most >= threshold / (1 + threshold) * (F.col("n") + F.col("low_n")) - 1e-9)


def _verified(pairs: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """``form, low, sim`` of the similar ones among distinct ``form, low``."""
    a, b = forms.select("form", "grams"), forms.select(F.col("form").alias("low"), F.col("grams").alias("low_grams"))
    both = pairs.join(a, "form").join(b, "low")
    common = F.size(F.array_intersect("grams", "low_grams"))
    sim = common / (F.size("grams") + F.size("low_grams") - common)
    return both.select("form", "low", sim.alias("sim")).where(F.col("sim") >= threshold)


def _pivot_rounds(posts: DataFrame, forms: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(``form, pivot`` of the forms that a pivot absorbs, ``form, low`` of all similar forms met); all other forms are pivots."""
    nothing = forms.select("form", F.col("form").alias("low")).limit(0)
    absorbed, met = nothing.withColumnRenamed("low", "pivot"), nothing
    active = posts
    while True:  # the lowest form of all edges is a pivot, so each round absorbs some
        edges = cut(_edges(active, forms, threshold))
        if edges.isEmpty():
            break
        met = met.union(edges.select("form", "low"))
        # A form with a similar lower one is no pivot in this round.
        held = edges.select(F.col("form").alias("low")).distinct()
        taken = edges.join(held, "low", "left_anti").groupBy("form").agg(F.max_by("low", F.struct("sim", -F.col("low"))).alias("pivot"))
        taken = cut(taken)
        absorbed = absorbed.union(taken)
        # Only forms that are still held take part in the next round.
        rest = edges.select("form").distinct().join(taken, "form", "left_anti")
        active = cut(active.join(rest, "form", "left_semi"))
        if active.isEmpty():
            break
    return absorbed, met


def _edge_rounds(edges: DataFrame) -> DataFrame:
    """``form, pivot`` of the forms that a pivot absorbs, by rounds over given ``form, low, sim``."""
    absorbed = edges.select("form", F.col("low").alias("pivot")).limit(0)
    while not edges.isEmpty():
        held = edges.select(F.col("form").alias("low")).distinct()
        taken = cut(edges.join(held, "low", "left_anti").groupBy("form").agg(F.max_by("low", F.struct("sim", -F.col("low"))).alias("pivot")))
        absorbed = absorbed.union(taken)
        rest = edges.select("form").distinct().join(taken, "form", "left_anti")
        edges = cut(edges.join(rest, "form", "left_semi").join(rest.withColumnRenamed("form", "low"), "low", "left_semi").select("form", "low", "sim"))
    return absorbed


def _follow(links: DataFrame, more: DataFrame) -> DataFrame:
    """``form, pivot`` where pivots that ``more`` gives to another pivot are replaced, and its own rows added."""
    step = more.select(F.col("form").alias("pivot"), F.col("pivot").alias("next"))
    moved = links.join(step, "pivot", "left").select("form", F.coalesce("next", "pivot").alias("pivot"))
    return moved.union(more.select("form", "pivot"))


def _medoids(assigned: DataFrame, forms: DataFrame) -> DataFrame:
    """``form, pivot, typical``: the mean share of a form's bigrams that its cluster's commits have, from sums per (cluster, bigram)."""
    rows = assigned.select("form", "pivot", "weight").join(forms.select("form", "grams"), "form").select("pivot", "form", "weight", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    held = rows.groupBy("pivot", "gram").agg(F.sum("weight").alias("w"))
    total = assigned.groupBy("pivot").agg(F.sum("weight").alias("all"))
    score = rows.join(held, ["pivot", "gram"]).groupBy("pivot", "form").agg(F.sum("w").alias("s"), F.max("n").alias("n"))
    return score.join(total, "pivot").select("pivot", "form", (F.col("s") / F.col("all") / F.sqrt("n")).alias("typical"))


def cluster_messages(mined: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``commit_hash, n_chars, form, cluster, size, typical, medoid`` of every commit with a message.

    ``cluster`` is a number that the members share, ``size`` counts commits, ``typical``
    orders members by how much of the cluster they share, and ``medoid`` marks the form
    that stands for the cluster. Commits without hash or message are left out; each
    commit counts once however many rows it has (the lowest form, should its messages
    differ); messages without words cluster by their other characters, or as one empty
    form; of equally similar pivots the lowest wins; messages of any length are read
    whole; an empty table gives no rows. Other columns are ignored whatever their names.
    """
    read = cut(message_forms(mined))
    commits = cut(read.groupBy("commit_hash").agg(F.min("form").alias("form"), F.min_by("n_chars", "form").alias("n_chars")))
    weights = commits.groupBy("form").agg(F.count(F.lit(1)).alias("weight"))
    forms = cut(read.where(F.col("grams").isNotNull()).groupBy("form").agg(F.first("grams").alias("grams")).join(weights, "form"))
    table = frequency_table(forms)
    posts = prefixes(forms, threshold, table)
    # A bigram of one form links nothing.
    shared = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = cut(posts.join(shared, "gram", "left_semi"))
    links, met = _pivot_rounds(posts, forms, threshold)
    links = cut(links)
    # Pivots meet each other.
    pivots = posts.join(links.select("form").distinct(), "form", "left_anti")
    again, met_again = _pivot_rounds(cut(pivots), forms, threshold)
    links = cut(_follow(links, again))
    late = cut(_late_edges(posts, links, forms, threshold, table))
    links = cut(_follow(links, _edge_rounds(late.join(links.select("form").distinct(), "form", "left_anti").select("form", "low", "sim"))))
    met_again = met_again.union(late.select("form", "low"))
    groups = links.select("pivot").distinct()
    several = forms.select("form", "weight").join(links, "form", "left").withColumn("pivot", F.coalesce("pivot", "form"))
    in_groups = cut(several.join(groups, "pivot", "left_semi"))

    # Members move to the closest medoid among the clusters of the forms they met.
    scored = _medoids(in_groups, forms)
    medoid = cut(scored.groupBy("pivot").agg(F.max_by("form", F.struct("typical", -F.col("form"))).alias("medoid")))
    shapes = medoid.join(forms.select(F.col("form").alias("medoid"), F.col("grams").alias("medoid_grams")), "medoid")
    met = met.union(met_again).join(in_groups.select(F.col("form").alias("low"), F.col("pivot").alias("other")), "low")
    options = met.select("form", "other").distinct().join(in_groups.select("form", F.col("pivot").alias("own")), "form").where("other <> own")
    tried = in_groups.select("form", F.col("pivot").alias("other")).union(options.select("form", "other"))
    tried = tried.join(options.select("form").distinct(), "form", "left_semi")
    tried = tried.join(forms.select("form", "grams"), "form").join(shapes.select(F.col("pivot").alias("other"), "medoid_grams"), "other")
    common = F.size(F.array_intersect("grams", "medoid_grams"))
    tried = tried.withColumn("sim", common / (F.size("grams") + F.size("medoid_grams") - common))
    best = tried.where(F.col("sim") >= threshold).groupBy("form").agg(F.max_by("other", F.struct("sim", -F.col("other"))).alias("best"))
    settled = cut(in_groups.join(best, "form", "left").select("form", "weight", F.coalesce("best", "pivot").alias("pivot")))

    final = cut(_medoids(settled, forms))
    size = settled.groupBy("pivot").agg(F.sum("weight").alias("size"))
    best = final.groupBy("pivot").agg(F.max_by("form", F.struct("typical", -F.col("form"))).alias("best")).join(size, "pivot")
    labelled = final.join(best, "pivot").withColumn("medoid", F.col("form") == F.col("best")).withColumnRenamed("pivot", "cluster")
    out = commits.join(labelled, "form", "left").join(weights, "form", "left")
    return out.select(
        "commit_hash", "n_chars", "form", F.coalesce("cluster", "form").alias("cluster"), F.coalesce("size", "weight").alias("size"),
        F.coalesce("typical", F.lit(1.0)).alias("typical"), F.coalesce("medoid", F.lit(True)).alias("medoid"),
    )


def describe_clusters(labelled: DataFrame, mined: DataFrame, members: int = 3) -> DataFrame:
    """``cluster, size, n_forms, typical_members`` of the clusters of two commits or more: the messages of the most typical forms.

    Sizes are sums and ranks are limited while sorting, so a large cluster never meets
    in one task.
    """
    rank = Window.partitionBy("cluster").orderBy(F.desc("typical"), "form")
    forms = labelled.where("size > 1").groupBy("cluster", "form").agg(F.max("typical").alias("typical"), F.max("size").alias("size"), F.min("commit_hash").alias("commit_hash"))
    counts = forms.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_forms"))
    shown = forms.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= members)
    texts = mined.where(F.col("message") != "").select("commit_hash", "message").join(shown.select("commit_hash"), "commit_hash", "left_semi").groupBy("commit_hash").agg(F.min("message").alias("message"))
    out = shown.join(texts, "commit_hash").groupBy("cluster").agg(
        F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]).alias("typical_members")
    )
    return out.join(counts, "cluster").select("cluster", "size", "n_forms", "typical_members")


def similar_pairs(labelled: DataFrame, min_chars: int = 100, block: int = BLOCK) -> DataFrame:
    """``commit_hash_a, commit_hash_b``: pairs of commits of one cluster with messages of ``min_chars`` characters, smaller hash first.

    Members are dealt to blocks of about ``block``, and any two blocks of a cluster meet
    in a task of their own, so a large cluster spreads over many.
    """
    long = labelled.where((F.col("n_chars") >= min_chars) & (F.col("size") > 1)).select("cluster", "commit_hash", F.ceil(F.col("size") / block).alias("blocks"))
    long = long.withColumn("own", F.pmod(F.xxhash64("commit_hash"), F.col("blocks")))
    first = long.select("cluster", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("commit_hash").alias("a"))
    second = long.select("cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("x"), F.col("own").alias("y"), F.col("commit_hash").alias("b"))
    both = first.join(second, ["cluster", "x", "y"]).where("x < y OR a < b")
    return both.select(F.least("a", "b").alias("commit_hash_a"), F.greatest("a", "b").alias("commit_hash_b"))
