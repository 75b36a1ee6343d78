"""Density clustering after Campello, Moulavi and Sander (2013).

Core distances, mutual reachability, minimum spanning tree, condensed tree, stability,
always over all rows. Up to ``max_fit`` rows are fitted at once. A larger table is dealt
to blocks of half that size, and every pair of blocks is one task: a row's nearest rows
are among those of the pairs that it is in, and the minimum spanning tree is part of
the union of the pairs' trees, as every edge lies in some pair. Forests are united in
rounds; the last task, and for clusters the driver, holds one edge a row, no vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

MAX_FIT = 20_000
_BLOCK = 1024
#: Forests that one task unites.
_FAN_IN = 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two arrays."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row to its k-th nearest row, itself counted as the first; the farthest one if there are fewer."""
    k = min(k, len(x))
    return np.concatenate([np.partition(distances(x[i : i + _BLOCK], x), k - 1, axis=1)[:, k - 1] for i in range(0, len(x), _BLOCK)]) if len(x) else np.zeros(0)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Rows (from, to, weight) of a minimum spanning tree of mutual reachability distances, by Prim's algorithm."""
    n = len(x)
    if n < 2:
        return np.zeros((0, 3))
    best, via = np.full(n, np.inf), np.zeros(n, dtype=int)
    inside = np.zeros(n, dtype=bool)
    at, out = 0, []
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(distances(x[at : at + 1], x)[0], np.maximum(core, core[at]))
        closer = ~inside & (reach < best)
        best[closer], via[closer] = reach[closer], at
        best[inside] = np.inf
        at = int(np.argmin(best))
        out.append((via[at], at, best[at]))
    return np.array(out)


def condense(tree: np.ndarray, n: int, smallest: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, lambda, size) of the condensed tree; clusters are numbered from n, the root first."""
    order = np.argsort(tree[:, 2], kind="stable")
    top = np.arange(2 * n - 1)
    node_of = np.arange(n)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right, dist, size = {}, {}, {}, np.ones(2 * n - 1, dtype=int)
    for step, e in enumerate(order):
        a, b = root(int(tree[e, 0])), root(int(tree[e, 1]))
        node = n + step
        left[node], right[node], dist[node] = int(node_of[a]), int(node_of[b]), float(tree[e, 2])
        size[node] = size[node_of[a]] + size[node_of[b]]
        parent[b], node_of[a] = a, node

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += [left[v], right[v]]
        return out

    rows: list[tuple[int, int, float, int]] = []
    nxt = n + 1
    stack = [(int(top[2 * n - 2]), n)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        lam = 1.0 / dist[node] if dist[node] > 0 else np.inf
        kids = (left[node], right[node])
        big = [k for k in kids if size[k] >= smallest]
        if len(big) == 2:
            for k in kids:
                rows.append((cluster, nxt, lam, int(size[k])))
                stack.append((k, nxt))
                nxt += 1
        else:
            for k in kids:
                if size[k] >= smallest:
                    stack.append((k, cluster))
                else:
                    rows += [(cluster, leaf, lam, 1) for leaf in leaves(k)]
    return rows


def density_labels(x: np.ndarray, min_cluster_size: int = 30, min_samples: int = 10, single: bool = True, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) of the rows: -1 is noise, clusters are numbered by their first row.

    Clusters are selected by excess of mass; one that split at a distance below
    ``epsilon`` is replaced by the ancestor that did not. ``single`` admits the root.
    """
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1), np.zeros(n)
    return tree_labels(spanning_tree(x, core_distances(x, min_samples)), n, min_cluster_size, single, epsilon)


def tree_labels(tree: np.ndarray, n: int, min_cluster_size: int = 30, single: bool = True, epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`density_labels` of ``n`` rows from their spanning tree."""
    if n < max(2, min_cluster_size):
        return np.full(n, -1), np.zeros(n)
    rows = condense(tree, n, min_cluster_size)
    birth, kids, stability = {n: 0.0}, {}, {n: 0.0}
    for p, c, lam, _ in rows:
        if c >= n:
            birth[c] = lam
            kids.setdefault(p, []).append(c)
            stability.setdefault(c, 0.0)
    finite = max([lam for _, _, lam, _ in rows if np.isfinite(lam)], default=1.0)
    for p, _, lam, size in rows:
        stability[p] += (min(lam, finite) - min(birth[p], finite)) * size
    chosen = {}
    for c in sorted(stability, reverse=True):
        below = sum(stability[k] for k in kids.get(c, []))
        if c == n and not single:
            chosen[c] = False
        elif kids.get(c) and below > stability[c]:
            chosen[c], stability[c] = False, below
        else:
            chosen[c] = True
    parent_of = {c: p for p, c, _, _ in rows if c >= n}

    def under_chosen(c: int) -> bool:
        while c in parent_of:
            c = parent_of[c]
            if chosen.get(c):
                return True
        return False

    picked = {c for c, yes in chosen.items() if yes and not under_chosen(c)}
    if epsilon > 0:
        raised = set()
        for c in picked:
            while c in parent_of and birth[c] > 0 and 1.0 / birth[c] < epsilon and (single or parent_of[c] != n):
                c = parent_of[c]
            raised.add(c)
        picked = {c for c in raised if not any(a in raised for a in _ancestors(c, parent_of))}
    labels, prob = np.full(n, -1), np.zeros(n)
    top_lam = {c: 0.0 for c in picked}
    member: list[tuple[int, int, float]] = []
    for p, c, lam, _ in rows:
        if c < n:
            owner = p
            while owner not in picked and owner in parent_of:
                owner = parent_of[owner]
            if owner in picked:
                if owner == n and len(picked) == 1 and epsilon > 0 and lam < 1.0 / epsilon:
                    continue
                member.append((c, owner, min(lam, finite)))
                top_lam[owner] = max(top_lam[owner], min(lam, finite))
    first: dict[int, int] = {}
    for c, owner, _ in sorted(member):
        first.setdefault(owner, len(first))
    for c, owner, lam in member:
        labels[c] = first[owner]
        prob[c] = 1.0 if top_lam[owner] <= 0 else lam / top_lam[owner]
    return labels, prob


def _ancestors(c: int, parent_of: dict[int, int]) -> Iterator[int]:
    while c in parent_of:
        c = parent_of[c]
        yield c


def forest(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a minimum spanning forest, by Kruskal's algorithm."""
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)].tolist(), ends[len(src) :].tolist()
    parent = list(range(len(nodes)))
    kept = []
    for e in np.lexsort((dst, src, weight)).tolist():
        i, j = a[e], b[e]
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[j] = i
            kept.append(e)
    return np.array(kept, dtype=int)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1 if len(column) else 0)


def _numbered(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``__id, key, vector`` of the rows with a vector, and their number."""
    rows = cut(df.where(F.col(vector).isNotNull()).select(F.monotonically_increasing_id().alias("__id"), key, vector))
    return rows, rows.count()


def _fitted(rows: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    pdf = rows.select("__id", key, vector).toPandas().sort_values([key, "__id"])
    return pdf["__id"].to_numpy(), _vectors(pdf[vector])


def _pairs(rows: DataFrame, n: int, max_fit: int) -> DataFrame:
    """``rows`` with ``__block``, once for each pair of blocks (``__low``, ``__high``) that the row's block is in."""
    blocks = max(2, -(-n // max(1, max_fit // 2)))
    own = rows.withColumn("__block", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    other = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("__other <> __block")
    return other.withColumns({"__low": F.least("__block", "__other"), "__high": F.greatest("__block", "__other")}).drop("__other")


def _core(rows: DataFrame, n: int, key: str, vector: str, k: int, max_fit: int) -> DataFrame:
    """``__id, core`` of every row against all rows."""
    k = min(k, n)
    if n <= max_fit:
        ids, x = _fitted(rows, key, vector)
        return rows.sparkSession.createDataFrame(pd.DataFrame({"__id": ids, "core": core_distances(x, k)}), "__id bigint, core double")

    def run(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = names
        x, block, ids = _vectors(pdf[vector]), pdf["__block"].to_numpy(), pdf["__id"].to_numpy()
        out: dict[str, list] = {"__id": [], "near": []}
        # A block meets itself beside its next one only, so no distance is counted twice.
        for mine, theirs in ((low, high), (high, low)):
            at = np.flatnonzero(block == mine)
            against = x if theirs == (mine + 1) % blocks else x[block == theirs]
            for i in range(0, len(at), _BLOCK):
                d = distances(x[at[i : i + _BLOCK]], against)
                if d.shape[1] > k:
                    d = np.partition(d, k - 1, axis=1)[:, :k]
                out["__id"] += ids[at[i : i + _BLOCK]].tolist()
                out["near"] += list(d)
        return pd.DataFrame(out)

    blocks = max(2, -(-n // max(1, max_fit // 2)))
    near = _pairs(rows.select("__id", vector), n, max_fit).groupBy("__low", "__high").applyInPandas(run, "__id bigint, near array<double>")
    return near.groupBy("__id").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), k).alias("core"))


def _tree(rows: DataFrame, n: int, key: str, vector: str, min_samples: int, max_fit: int) -> DataFrame:
    """``src, dst, weight`` by ``__id``: the spanning tree of mutual reachability of all rows."""
    shape = "src bigint, dst bigint, weight double"
    if n <= max_fit:
        ids, x = _fitted(rows, key, vector)
        t = spanning_tree(x, core_distances(x, min_samples))
        pdf = pd.DataFrame({"src": ids[t[:, 0].astype(int)], "dst": ids[t[:, 1].astype(int)], "weight": t[:, 2]})
        return rows.sparkSession.createDataFrame(pdf, shape)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["__id"].to_numpy()
        t = spanning_tree(_vectors(pdf[vector]), pdf["core"].to_numpy())
        return pd.DataFrame({"src": ids[t[:, 0].astype(int)], "dst": ids[t[:, 1].astype(int)], "weight": t[:, 2], "part": pdf["__low"].iloc[0] * blocks + pdf["__high"].iloc[0]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[forest(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy())]

    blocks = max(2, -(-n // max(1, max_fit // 2)))
    core = _core(rows, n, key, vector, min_samples, max_fit)
    edges = cut(_pairs(rows.select("__id", vector).join(core, "__id"), n, max_fit).groupBy("__low", "__high").applyInPandas(fit, shape + ", part bigint"))
    parts = blocks * blocks
    while parts > 1:
        parts = -(-parts // _FAN_IN)
        edges = cut(edges.withColumn("part", F.floor(F.col("part") / _FAN_IN).cast("bigint")).groupBy("part").applyInPandas(unite, shape + ", part bigint"))
    return edges.select("src", "dst", "weight")


def core_distance_rows(df: DataFrame, key: str, vector: str, k: int = 10, max_fit: int = MAX_FIT) -> DataFrame:
    """``key, core_distance`` of every row against the whole table, at most ``max_fit`` rows in a task."""
    rows, n = _numbered(df, key, vector)
    return rows.join(_core(rows, n, key, vector, k, max_fit), "__id").select(key, F.col("core").alias("core_distance"))


def spanning_edges(df: DataFrame, key: str, vector: str, min_samples: int = 10, max_fit: int = MAX_FIT) -> DataFrame:
    """``src, dst, weight``: the spanning tree of mutual reachability over all rows, at most ``max_fit`` vectors in a task."""
    rows, n = _numbered(df, key, vector)
    names = rows.select("__id", key)
    tree = _tree(rows, n, key, vector, min_samples, max_fit)
    named = tree.join(names.select(F.col("__id").alias("src"), F.col(key).alias("__from")), "src").join(names.select(F.col("__id").alias("dst"), F.col(key).alias("__to")), "dst")
    return named.select(F.col("__from").alias("src"), F.col("__to").alias("dst"), "weight")


def cluster_by_density(df: DataFrame, key: str, vector: str, min_cluster_size: int = 30, min_samples: int = 10, single: bool = True, epsilon: float = 0.0, max_fit: int = MAX_FIT) -> DataFrame:
    """``key, label, probability`` of every row with a vector; -1 is noise. At most ``max_fit`` vectors meet in a task; the driver holds the tree."""
    rows, n = _numbered(df, key, vector)
    tree = _tree(rows, n, key, vector, min_samples, max_fit).toPandas()
    ids = rows.select("__id", key).toPandas().sort_values([key, "__id"])["__id"].to_numpy()
    order = np.argsort(ids)
    ends = [order[np.searchsorted(ids, tree[c].to_numpy(), sorter=order)].astype(float) for c in ("src", "dst")]
    labels, prob = tree_labels(np.column_stack([*ends, tree["weight"].to_numpy()]), n, min_cluster_size, single, epsilon)
    out = df.sparkSession.createDataFrame(pd.DataFrame({"__id": ids, "label": labels, "probability": prob}), "__id bigint, label int, probability double")
    return rows.join(out, "__id").select(key, "label", "probability")


def cluster_parameters(n: int, min_cluster_size: int | None = None, min_samples: int | None = None, size_share: float = 0.01, samples_share: float = 0.5) -> tuple[int, int]:
    """(min_cluster_size, min_samples): as given, or shares of the number of rows and of the size, at least 15 and 5."""
    size = min_cluster_size if min_cluster_size and min_cluster_size > 0 else max(15, int(n * size_share))
    return size, min_samples if min_samples and min_samples > 0 else max(5, int(size * samples_share))
