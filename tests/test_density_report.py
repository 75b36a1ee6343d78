import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from commitloom.operators import density, embed, report, stats


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), rng.uniform(-20, 20, (12, 2))])


def test_core_distances_and_tree_by_brute_force():
    x = blobs()
    core = density.core_distances(x, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(core, np.sort(d, axis=1)[:, 4], atol=1e-6)
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    parent, total = list(range(len(x))), 0.0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in sorted((reach[i, j], i, j) for i in range(len(x)) for j in range(i)):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            total += w
    assert np.isclose(density.spanning_tree(x, core)[:, 2].sum(), total)


def test_density_labels():
    labels, prob = density.density_labels(blobs(), 10, 5, single=False)
    assert len(set(labels[:40].tolist()) - {-1}) == 1 and len(set(labels[40:80].tolist()) - {-1}) == 1 and labels[0] != labels[45]
    assert (labels[80:] == -1).mean() > 0.6 and prob.max() == 1.0
    assert (density.density_labels(blobs()[:5], 10, 5)[0] == -1).all()
    assert (density.density_labels(np.zeros((30, 2)), 5, 3)[0] >= -1).all()
    assert density.cluster_parameters(1000) == (15, 7) and density.cluster_parameters(10, 30, 10) == (30, 10)


def test_density_rows_follow_a_sample(spark):
    pdf = pd.DataFrame({"k": range(92), "v": blobs().tolist()})
    df = spark.createDataFrame(pdf, "k bigint, v array<double>")
    whole = {r.k: r.label for r in density.cluster_by_density(df, "k", "v", 10, 5, single=False).collect()}
    part = {r.k: r.label for r in density.cluster_by_density(df, "k", "v", 8, 4, single=False, max_fit=70).collect()}
    assert len(whole) == len(part) == 92
    assert len({part[k] for k in range(40)} - {-1}) == 1 and len({part[k] for k in range(40, 80)} - {-1}) == 1
    assert density.spanning_edges(df, "k", "v").count() == 91
    assert stats.cluster_summary(density.cluster_by_density(df, "k", "v", 10, 5, single=False), "label").first().n_clusters == 2


def test_tables_above_max_fit_are_fitted_whole(spark):
    x = blobs(3)
    df = spark.createDataFrame(pd.DataFrame({"k": range(92), "v": x.tolist()}), "k bigint, v array<double>")
    core = density.core_distances(x, 5)
    assert np.allclose([r.core_distance for r in density.core_distance_rows(df, "k", "v", 5, max_fit=20).orderBy("k").collect()], core, atol=1e-6)
    edges = density.spanning_edges(df, "k", "v", 5, max_fit=20).toPandas()
    assert len(density.forest(edges.src.to_numpy(), edges.dst.to_numpy(), edges.weight.to_numpy())) == len(edges) == 91
    assert np.allclose(np.sort(edges.weight), np.sort(density.spanning_tree(x, core)[:, 2]), atol=1e-6)
    labels, prob = density.density_labels(x, 10, 5, single=False)
    got = density.cluster_by_density(df, "k", "v", 10, 5, single=False, max_fit=20).orderBy("k").collect()
    assert [r.label for r in got] == labels.tolist() and np.allclose([r.probability for r in got], prob, atol=1e-4)
    assert density.spanning_edges(df.limit(0), "k", "v").count() == density.core_distance_rows(df.limit(0), "k", "v").count() == 0


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "fix subnet route"), (2, "fix subnet"), (3, None), (4, "other words here")], "id int, t string")
    v = {r.id: np.array(r.embedding) for r in embed.tfidf(df, F.col("t"), 64).collect()}
    assert v[1] @ v[2] > v[1] @ v[4] and np.isclose(np.linalg.norm(v[1]), 1) and np.linalg.norm(v[3]) == 0
    calls = lambda s: [[float(len(x)), 1.0] for x in s]
    cache = str(tmp_path / "vectors")
    one = embed.embed_cached(df, "t", cache, calls)
    assert {r.id: r.embedding for r in one.collect()}[2] == [10.0, 1.0]
    before = spark.read.parquet(cache).count()
    assert embed.embed_cached(df, "t", cache, calls).count() == 4 and spark.read.parquet(cache).count() == before
    assert len(embed.reduce_pca(embed.tfidf(df, F.col("t"), 16), "embedding", 2).first().reduced) == 2


def test_cluster_report(spark):
    rows = [(i, 0, f"pin the subnet route {i % 3}") for i in range(6)] + [(9, -1, "lonely " * 60)]
    df = spark.createDataFrame(rows, "id int, label int, t string")
    lines = list(report.report_lines(report.cluster_report(df, "label", "id", "t", "t", ("the",), top=3, with_context=2, examples=2), "label"))
    assert lines[0].startswith("Noise: 1 messages (14.29%)") and lines[1].endswith('..."')
    assert any("subnet: 6" in x for x in lines) and any("**route**" in x for x in lines) and lines[-1].startswith("  Theme")
    over = stats.corpus_overview(df.withColumn("at", F.current_date()), "t", "label", "at")
    text = report.overview_markdown(over, spark.createDataFrame([(".tf", 2)], "ext string, n_commits int"))
    assert "| Commits | 7 |" in text and "| .tf | 2 |" in text
