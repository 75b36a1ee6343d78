import random
import re

import numpy as np
from pyspark.sql import functions as F

from commitloom.functions.tokens import PY_TOKEN
from commitloom.llm import packing as P
from commitloom.llm import truncation as T


def test_pack_shard_neighbours_first():
    sizes = np.array([6, 3, 3, 4, 1])
    rows = np.array([0, 1, 2, 3, 4])
    terms = np.array([7, 8, 7, 8, 9])  # item 2 shares a term with item 0
    boxes = P.pack_shard(sizes, rows, terms, np.ones(5), 10)
    assert boxes[0] == [0, 2, 4] and sorted(i for b in boxes for i in b) == [0, 1, 2, 3, 4]
    assert all(sizes[b].sum() <= 10 for b in boxes)
    assert P.pack_shard(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), 10) == []


def test_pack_documents(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["alpha ", "beta ", "gam, "]) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["w " * 205, "w " * 100, "w " * 200, "", None, "né ç " * 3, "w " * 100]
    rows = [(2**60 + i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"size": F.lit("x"), "terms": F.lit(1), "container": F.lit(None), "shard": F.lit(3)})
    got = P.pack_documents(docs, capacity=100, shard_tokens=4000)
    pdf = got.toPandas()
    count = {i: len(re.findall(PY_TOKEN, t or "")) for i, t in rows}
    assert {i for i in got.where("n_pieces > 1").select("doc_id").distinct().toPandas().doc_id} == {i for i, n in count.items() if n > 100}
    per = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert per == count
    boxes = pdf[pdf.container.notna()].groupby("container").n_tokens.sum()
    assert boxes.max() <= 100 and boxes.sum() / (len(boxes) * 100) > 0.97
    assert pdf.container.isna().sum() == 2 and not pdf[pdf.container.notna()].duplicated(["container", "slot"]).any()
    split = got.where(F.col("doc_id") == 2**60 + 400).orderBy("piece").collect()
    assert [(r.token_start, r.n_tokens, r.n_pieces) for r in split] == [(0, 100, 3), (100, 100, 3), (200, 5, 3)]
    assert P.pack_documents(docs.limit(0), 100).count() == 0
    assert P.packing_report(got, 100).first().n_tokens == sum(count.values())


def test_common_terms_count(spark):
    # Two terms that half of all texts have each: only they tell the groups apart.
    docs = spark.createDataFrame([(i, ("plan " if i % 2 else "drift ") * 5 + f"own{i}") for i in range(8)], "doc_id int, text string")
    got = P.pack_documents(docs, capacity=12).groupBy("container").agg(F.collect_set(F.col("doc_id") % 2).alias("groups")).collect()
    assert len(got) == 4 and all(len(r.groups) == 1 for r in got)


def test_neighbours_beyond_the_first():
    # Item 2 fits beside the seed; then 60 near ones don't, and a farther one does, before an unrelated one of its size.
    sizes = np.array([5, 1, 4] + [2] * 60 + [1])
    rows, weights = np.array([0, 2, *range(3, 63), 63]), np.array([1.0, 9.0, *[5.0] * 60, 1.0])
    assert P.pack_shard(sizes, rows, np.zeros(63, dtype=int), weights, 10)[0] == [0, 2, 63]


def test_similar_texts_share_a_shard(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{g}x{rng.randrange(12)}" for _ in range(40)) for g in range(40) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = P.pack_documents(docs, capacity=160, shard_tokens=640).where("container IS NOT NULL")
    shards = got.select(F.col("doc_id"), F.split("container", "-")[0].alias("s")).toPandas()
    together = shards.groupby(shards.doc_id // 4).s.apply(lambda s: s.value_counts().max())
    assert together.mean() > 2.4 and shards.groupby("s").size().max() <= 48  # by hash about 1.6
    same = spark.createDataFrame([(i, "same words here") for i in range(400)], "doc_id int, text string")
    spread = P.pack_documents(same, capacity=30, shard_tokens=120).groupBy(F.split("container", "-")[0]).count().toPandas()
    assert len(spread) == 10 and spread["count"].max() <= 80


def test_endings():
    form = lambda t: T.ending(t)[0]
    want = {
        "": "empty", "  \n": "empty", "All is well.": "whole", "It (works)": "whole", "a\n```\nx = 1\n```": "whole", "Done. Then it [truncated]": "marked", "One. Two (cont": "marked", "One. aff�": "marked",
        "One. Two. And the": "open", "See:\n\n```hcl\nx = {": "open", "A sentence. Waiting...": "ellipsis", "Guard route for mir": "title", "v5.0.1": "loose", "Text.\n\n- pin route mir": "loose", "Text.\n\nCheers, Mir Len": "loose",
        "Text.\n\nSigned-off-by: A <a@b.c>": "whole", "Text.\n\nSigned-off-by: A <a@b": "open", "Text.\n\nhttps://a.b/c": "loose", "Text.\n\nFixes #12": "loose", "Text.\n* The route was moved into": "open",
    }
    assert {t: form(t) for t in want} == want


def test_truncated(spark):
    rng = random.Random(2)
    nouns = ["network", "instance", "certificate", "pipeline", "dashboard", "rotation", "subnet", "gateway"]
    sentence = lambda: f"The {rng.choice(nouns)} waits for the {rng.choice(nouns)} and the {rng.choice(nouns)}."
    whole = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = [(i, t, "plain") for i, t in enumerate(whole)]
    rows += [(1000 + i, (" ".join(sentence() for _ in range(9)))[:120], "capped") for i in range(40)]
    rows += [(2000, "One thing. The pipeline waits for the certif", "plain"), (2001, "Guard certificate dashboa", "plain"), (2002, "Guard certificate dashboard", "plain"), (2003, "It waits. More to come...", "a"), (2004, "They wait. More to come...", "b"), (2005, "We wait. More to come...", "c"), (2006, "It waits. The pipeline of...", "plain")]
    rows += [(2007, None, "plain"), (2008, "", None), (2009, "x" * 500_000 + ".", None), (2010, "Cut here. And the", None), (2010, "Cut here. And the", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"form": F.lit("q"), "token": F.lit(1), "evidence": F.lit(None), "texts": F.lit(2)})
    got = {r.doc_id: r.evidence for r in T.find_truncated(docs).collect()}
    cut = {i for i, e in got.items() if e}
    at_limit = {i for i, t, s in rows if s == "capped" and not t.rstrip().endswith(".")}
    assert cut == at_limit | {2000, 2001, 2006, 2010}
    clues = {i: set((e or "").split("+")) for i, e in got.items()}
    assert "word" in clues[2000] and clues[2001] == {"word"} and all("length" in clues[i] for i in at_limit) and any(clues[i] >= {"length", "word"} for i in at_limit)
    alone = {r.doc_id for r in T.find_truncated(docs, forms=False).where("truncated").collect()}
    assert alone == {i for i, c in clues.items() if c & {"word", "length"}} == at_limit | {2000, 2001}
    per = {r.source: (r.n_docs, r.n_truncated) for r in T.truncation_by_source(T.find_truncated(docs)).collect()}
    assert per["capped"] == (40, len(at_limit)) and per[None] == (4, 2)
    assert T.find_truncated(docs.limit(0)).count() == 0


def test_stumps_in_marked_and_rare_texts(spark):
    texts = [f"Step {i} waits for the dashboard. Then for the gateway. All is well {i}." for i in range(1100)] + ["Guard subnet dashboa [truncated]", "Pin the dashboa", "Pin the gatew", "We call it gatew here.", "Pin the dashboard"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit(None).cast("string"))
    got = {r.doc_id: r.evidence for r in T.find_truncated(docs).where("truncated").collect()}
    assert got == {1100: "mark", 1101: "word", 1102: "word"}


def test_trie_against_brute_force(spark):
    words = ["a", "an", "ant", "anthem", "bee", "beetle", "café"]
    v = spark.createDataFrame([(w, 1, 0) for w in words], "word string, texts bigint, closing bigint")
    wanted = spark.createDataFrame([(t,) for t in ("an", "be", "caf", "zoo", "anthem", "a")], "token string")
    got = {r.token: r.below for r in T.trie_nodes(v, wanted).collect()}
    assert got == {t: n for t in ("an", "be", "caf", "zoo", "anthem", "a") if (n := sum(w != t and w.startswith(t) for w in words))}
