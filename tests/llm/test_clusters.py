import itertools
import random

from pyspark.sql import functions as F

from commitloom.llm import clusters as C

WORDS = [a + b + c for a in ("tor", "mir", "vel", "xan", "ost") for b in ("dal", "kam", "run", "fen") for c in ("", "or", "ix", "una")]


def corpus(seed=3, families=40):
    """Families of edited copies: (hash, message, family)."""
    rng, out = random.Random(seed), []
    for f in range(families):
        base = [rng.choice(WORDS) for _ in range(rng.randint(18, 30))]
        for _ in range(rng.choice((1, 1, 2, 3, 9))):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            text = " ".join(w)
            text = rng.choice((text, text.upper(), text.replace(" ", "\n", 3), text + "\n\nSigned-off-by: A <a@b.c>", "Merge pull request #7 from x/y\n\n" + text, text + " (#123)"))
            out.append((f"{rng.getrandbits(160):040x}", text, f))
    return out


def test_against_brute_force(spark, mined):
    rows = corpus()
    df = mined([{"commit_hash": h, "message": m, "file": str(i)} for h, m, _ in rows for i in range(2)])
    got = C.cluster_messages(df)
    pairs = {(r.commit_hash_a, r.commit_hash_b) for r in C.similar_pairs(got, 1).collect()}
    grams = {h: set(C.bigrams(C.normal_form(m))) for h, m, _ in rows}
    near = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if len(grams[a] & grams[b]) >= C.SIMILARITY * len(grams[a] | grams[b])}
    family = {h: f for h, _, f in rows}
    assert near <= pairs
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(family), 2) if family[a] == family[b]}
    per = got.toPandas()
    assert len(per) == len(rows) and (per.groupby("cluster")["size"].first() == per.groupby("cluster").size()).all()
    assert (per[per.medoid].groupby("cluster")["form"].nunique() == 1).all()
    again = C.cluster_messages(df.repartition(9)).toPandas().sort_values("commit_hash")["cluster"].tolist()
    assert again == per.sort_values("commit_hash")["cluster"].tolist()
    shown = C.describe_clusters(got, df).collect()
    assert shown and all(1 <= len(r.typical_members) <= 3 and r.size >= 2 for r in shown)


def test_lower_forms_hide_no_pair(spark, mined):
    form = lambda m: C.xxhash.xxh64_intdigest(" ".join(C.normal_form(m))) >> 1
    stock = WORDS[:10]
    pair = [" ".join([*stock, *WORDS[i : i + 5]]) for i in (20, 30)]
    # Each bigram that the pair shares is also held by a lower form that is like neither.
    hiding = [next(m for a in WORDS for b in WORDS if form(m := f"{stock[i]} {stock[i + 1]} {a}{b}") < min(map(form, pair))) for i in range(9)]
    df = mined([{"commit_hash": str(i), "message": m} for i, m in enumerate(pair + hiding)])
    assert {(r.commit_hash_a, r.commit_hash_b) for r in C.similar_pairs(C.cluster_messages(df), 1).collect()} == {("0", "1")}


def test_edges(spark, mined):
    df = mined([
        {}, {"commit_hash": "", "message": "x"}, {"commit_hash": "a", "message": None}, {"commit_hash": "b", "message": ""}, {"commit_hash": "c", "message": "!!!"}, {"commit_hash": "d", "message": "!!!"},
        {"commit_hash": "e", "message": "word"}, {"commit_hash": "f", "message": "Word\r\n"}, {"commit_hash": "g", "message": "long " * 300_000}, {"commit_hash": "e", "message": "word", "file": "again"},
    ]).withColumns({"form": F.lit("x"), "cluster": F.lit(1), "grams": F.lit(None), "n_chars": F.lit("y")})
    got = {r.commit_hash: r for r in C.cluster_messages(df).collect()}
    assert set(got) == set("cdefg")
    assert got["e"].cluster == got["f"].cluster and got["e"].size == 2 and got["c"].cluster == got["d"].cluster != got["e"].cluster
    assert C.cluster_messages(df.limit(0)).count() == 0
    assert C.similar_pairs(C.cluster_messages(df.limit(0))).count() == 0


def small_vocabulary(n, seed=7):
    """Texts over few words, each with one edited copy: (hash, message)."""
    rng, out = random.Random(seed), []
    for i in range(n // 2):
        w = [rng.choice(WORDS[:60]) for _ in range(18)]
        v = list(w)
        v[rng.randrange(18)] = rng.choice(WORDS[:60])
        out += [(f"{2 * i:040x}", " ".join(w)), (f"{2 * i + 1:040x}", " ".join(v))]
    return out


def test_crowded_buckets_lose_no_pair(spark):
    rows = small_vocabulary(600) + [(f"s{i}", f"bump version {a} {b}") for i, (a, b) in enumerate(itertools.product(WORDS[:6], WORDS[6:12]))]
    df = spark.createDataFrame(rows, "commit_hash string, message string")
    forms = C.message_forms(df).where("grams IS NOT NULL").groupBy("form").agg(F.first("grams").alias("grams")).cache()
    table = C.frequency_table(forms)
    posts, nothing = C.prefixes(forms, C.SIMILARITY, table).cache(), spark.createDataFrame([], "form bigint, pivot bigint")
    pairs = [{frozenset((r.form, r.low)) for r in C._late_edges(posts, nothing, forms, C.SIMILARITY, table, split).collect()} for split in (1 << 30, 3)]
    grams = {r.form: set(r.grams) for r in forms.collect()}
    near = {frozenset((a, b)) for a, b in itertools.combinations(grams, 2) if len(grams[a] & grams[b]) >= C.SIMILARITY * len(grams[a] | grams[b])}
    assert pairs[0] == near and pairs[1] <= near
    # Forms that share all they need meet the lowest one only, so split buckets may link them through it.
    linked = dict.fromkeys(grams)
    for start in grams:
        if linked[start] is None:
            todo = [start]
            while todo:
                x = todo.pop()
                if linked[x] is None:
                    linked[x] = start
                    todo += [y for p in pairs[1] if x in p for y in p]
    assert all(linked[a] == linked[b] for a, b in near)


def test_pairs_of_large_clusters(spark):
    labelled = spark.range(25).select(F.format_string("%02d", "id").alias("commit_hash"), F.lit(1).alias("cluster"), F.lit(25).cast("bigint").alias("size"), F.lit(100).alias("n_chars"))
    got = [tuple(r) for r in C.similar_pairs(labelled, block=4).collect()]
    assert sorted(got) == sorted(itertools.combinations([f"{i:02d}" for i in range(25)], 2))
