"""Filling containers of fixed capacity with whole texts that belong together.

Texts are dealt to shards of bounded size by weighted min-hashing: each text samples one
of its terms by BM25 weight, so that similar texts tend to sample the same one, and the
texts of a term share a shard. Each shard has a BM25 inverted
index of its texts, weighted by document frequencies of the whole corpus. The largest
unused text of a shard is the seed of a container; the index returns its unused
neighbours, which fill the container greedily while they fit, and the largest texts
that still fit close the gap. Only a text larger than a container is split: into full
containers and a rest that is packed like any other text.

Ids travel through Python as strings, so ids of any type, nulls among them, stay exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import PY_TOKEN
from ..lineage import cut

TOKEN = re.compile(PY_TOKEN)
#: Hash buckets of terms; a fixed size, whatever the corpus.
TERMS = 1 << 18
K1, B = 1.2, 0.75
#: Neighbours looked at before all are sorted.
FIRST = 48
#: Parts of a term's texts, by a second sampled term, if they exceed a shard.
PARTS = 64

_ITEM = "doc_id string, n_tokens bigint, n_pieces int, start bigint, size int, starts array<int>, terms array<int>, tfs array<int>"
_PLACED = "doc_id string, piece int, n_pieces int, token_start bigint, n_tokens int, container string, slot int"


def _items(capacity: int):
    """Per text: tokens, number of pieces, character starts of the pieces (of split texts) and its terms with frequencies."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[str, int] = {}
        for pdf in it:
            out = {k: [] for k in ("n_tokens", "n_pieces", "start", "size", "starts", "terms", "tfs")}
            for text in pdf["text"]:
                text = text if isinstance(text, str) else ""
                tokens = TOKEN.findall(text)
                n = len(tokens)
                full = (n - 1) // capacity if n > capacity else 0
                starts = None
                if full:
                    starts = [m.start() for m in islice(TOKEN.finditer(text), 0, None, capacity)]
                    tokens = tokens[full * capacity :]
                if len(ids) > 1_000_000:
                    ids.clear()
                tf: dict[int, int] = {}
                for w, c in Counter(tokens).items():
                    k = ids.get(w)
                    if k is None:
                        k = ids[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % TERMS if w[0].isalnum() else -1
                    if k >= 0:
                        tf[k] = tf.get(k, 0) + c
                for k, v in (("n_tokens", n), ("n_pieces", full + 1), ("start", full * capacity), ("size", n - full * capacity), ("starts", starts), ("terms", list(tf)), ("tfs", list(tf.values()))):
                    out[k].append(v)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **out})

    return run


def pack_shard(sizes: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of item numbers) of one shard.

    ``rows, terms, weights``: the BM25 weight of each (item, term). Every item goes
    into exactly one container; none exceeds ``capacity``. Seeds go by falling size.
    """
    n = len(sizes)
    order = np.lexsort((rows, terms))
    post_items, post_weights = rows[order], weights[order]
    vocab, firsts = np.unique(terms[order], return_index=True)
    ends = np.append(firsts[1:], len(order))
    at = np.searchsorted(vocab, terms)
    row_starts = np.searchsorted(rows, np.arange(n + 1))
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.lexsort((-np.arange(n), sizes)).tolist():
        by_size[sizes[i]].append(i)
    have = sum(1 << s for s in range(capacity + 1) if by_size[s])
    used = np.zeros(n, dtype=bool)

    def largest(room: int) -> int:
        """The first unused item of the largest size within ``room``, or -1."""
        nonlocal have
        while True:
            s = (have & ((2 << room) - 1)).bit_length() - 1
            if s < 0:
                return -1
            stack = by_size[s]
            while stack and used[stack[-1]]:
                stack.pop()
            if stack:
                return stack[-1]
            have &= ~(1 << s)

    out = []
    while (seed := largest(capacity)) >= 0:
        used[seed] = True
        box, room = [seed], capacity - int(sizes[seed])
        if room and largest(room) >= 0:
            mine = at[row_starts[seed] : row_starts[seed + 1]]
            spans = [slice(firsts[k], ends[k]) for k in mine.tolist()]
            if spans:
                scores = np.bincount(np.concatenate([post_items[s] for s in spans]), np.concatenate([post_weights[s] for s in spans]), minlength=n)
                scores[used | (sizes > room)] = 0.0
                top = float(np.partition(scores, n - FIRST)[n - FIRST]) if n > FIRST else 0.0
                for near in (scores >= top, scores < top):
                    if not room or largest(room) < 0:
                        break
                    near = np.flatnonzero(near & (scores > 0.0) & (sizes <= room))
                    for j in near[np.argsort(-scores[near], kind="stable")].tolist():
                        if sizes[j] <= room:
                            used[j] = True
                            box.append(j)
                            room -= int(sizes[j])
                            if not room:
                                break
            while (j := largest(room)) >= 0:
                used[j] = True
                box.append(j)
                room -= int(sizes[j])
        out.append(box)
    return out


def _bm25(tf: np.ndarray, sizes: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / max(mean, 1.0)))


def _idf(table: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - table + 0.5) / (table + 0.5))


def sampled_terms(terms: pd.Series, tfs: pd.Series, sizes: pd.Series, draws: np.ndarray, table: np.ndarray, mean: float) -> np.ndarray:
    """A term of each text for every row of ``draws``, which all texts share; TERMS if no other text has any of its terms."""
    lens = terms.str.len().to_numpy(dtype=np.int64)
    out = np.full((len(lens), len(draws)), TERMS, dtype=np.int64)
    if not lens.sum():
        return out
    rows = np.repeat(np.arange(len(lens)), lens)
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in terms])
    tf = np.concatenate([np.asarray(t, dtype=np.float64) for t in tfs])
    shared = table[flat] > 1
    rows, flat, tf = rows[shared], flat[shared], tf[shared]
    if not len(rows):
        return out
    at, firsts, n = np.unique(rows, return_index=True, return_counts=True)
    weights = _bm25(tf, sizes.to_numpy()[rows], mean)
    for k, of in enumerate(draws):
        own = of[flat] / weights
        hits = np.flatnonzero(own == np.repeat(np.minimum.reduceat(own, firsts), n))
        out[rows[hits[::-1]], k] = flat[hits[::-1]]
    return out


def _sharded(items: DataFrame, shards: int, table: np.ndarray, docs: int, mean: float) -> DataFrame:
    """``items`` with ``shard``: texts of one sampled term together; a term or part of one above a shard's size is spread by hash."""
    if shards == 1:
        return items.withColumn("shard", F.lit(0))
    draws = -np.log(np.random.default_rng(0).random((2, TERMS))) / _idf(table, docs)

    @F.pandas_udf("key int, part int")
    def keys(terms: pd.Series, tfs: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        k = sampled_terms(terms, tfs, sizes, draws, table, mean)
        return pd.DataFrame({"key": k[:, 0], "part": k[:, 1] % PARTS})

    items = cut(items.withColumn("k", keys("terms", "tfs", "size")))
    keyed = items.groupBy("k.key").agg(F.sum("size").alias("n"))
    size = np.zeros(TERMS + 1)
    for r in keyed.toLocalIterator():  # at most TERMS + 1 rows
        size[r.key] = r.n
    each = size.sum() / shards
    start = np.cumsum(size) - size
    hot = np.flatnonzero(size > each)
    place = np.full(TERMS + 1, -1)
    place[hot] = np.arange(len(hot))  # fewer than shards
    inner = np.zeros((len(hot), PARTS))
    if len(hot):
        parts = items.where(F.col("k.key").isin(hot.tolist())).groupBy("k.key", "k.part").agg(F.sum("size").alias("n"))
        for r in parts.toLocalIterator():  # at most PARTS rows a shard
            inner[place[r.key], r.part] = r.n
    inner_start = np.cumsum(inner, axis=1) - inner

    spread = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @F.pandas_udf("int")
    def shard(key: pd.Series, part: pd.Series, at: pd.Series) -> pd.Series:
        key, part = key.to_numpy(), part.to_numpy()
        base, width = start[key], size[key]
        big = np.flatnonzero(place[key] >= 0)
        if len(big):
            cell = place[key[big]], part[big]
            base[big], width[big] = base[big] + inner_start[cell], inner[cell]
        within = np.where(width > each, at.to_numpy(), 0.5)
        return pd.Series(np.minimum((base + width * within) // each, shards - 1).astype(np.int32))

    return items.withColumn("shard", shard("k.key", "k.part", spread)).drop("k")


def _pack(capacity: int, table: np.ndarray, docs: int, mean: float):
    idf = _idf(table, docs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "size"], kind="stable", na_position="first")
        sizes = pdf["size"].to_numpy(dtype=np.int64)
        lens = pdf["terms"].str.len().to_numpy(dtype=np.int64)
        rows = np.repeat(np.arange(len(sizes)), lens)
        terms = np.concatenate([np.asarray(t, dtype=np.int64) for t in pdf["terms"]]) if lens.sum() else np.zeros(0, dtype=np.int64)
        tf = np.concatenate([np.asarray(t, dtype=np.float64) for t in pdf["tfs"]]) if lens.sum() else np.zeros(0)
        weights = idf[terms] * _bm25(tf, sizes[rows], mean)
        boxes = pack_shard(sizes, rows, terms, weights, capacity)
        flat = np.array([i for box in boxes for i in box], dtype=np.int64)
        lengths = np.array([len(b) for b in boxes], dtype=np.int64)
        box = np.repeat(np.arange(len(boxes)), lengths)
        slot = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        src = pdf.iloc[flat]
        shard = pdf["shard"].iloc[0]
        return pd.DataFrame({
            "doc_id": src["doc_id"].to_numpy(), "piece": (src["n_pieces"] - 1).to_numpy(), "n_pieces": src["n_pieces"].to_numpy(), "token_start": src["start"].to_numpy(),
            "n_tokens": src["size"].to_numpy(), "container": [f"s{shard}-{b}" for b in box], "slot": slot,
        })

    return run


def pack_documents(documents: DataFrame, capacity: int = 1024, shard_tokens: int = 1_500_000) -> DataFrame:
    """``doc_id, piece, n_pieces, token_start, n_tokens, container, slot``: where every text, or piece of one, goes.

    documents: ``doc_id, text``. A text of more than ``capacity`` tokens is cut at
    multiples of ``capacity``; all others stay whole. A shard holds about
    ``shard_tokens`` tokens, so its index fits in a task whatever the corpus. Null and empty texts have no tokens and
    are placed in no container (``container`` is null); repeated rows are placed as often as
    they occur; of equally near neighbours the lower id comes first; an empty table
    gives no rows. Texts of any length are read whole; other columns are ignored
    whatever their names.
    """
    kind = documents.schema["doc_id"].dataType
    items = cut(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_items(capacity), _ITEM))
    stats = items.agg(F.count_if(F.col("size") > 0).alias("docs"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"), F.sum("size").alias("tokens")).first()
    table = np.zeros(TERMS)
    for r in items.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # at most TERMS rows
        table[r.t] = r.n
    shards = max(1, -(-int(stats.tokens or 0) // shard_tokens))
    keyed = _sharded(items.where(F.col("size") > 0).drop("starts"), shards, table, stats.docs or 0, stats.mean or 1.0)
    packed = keyed.select("shard", "doc_id", "n_pieces", "start", "size", "terms", "tfs").groupBy("shard").applyInPandas(_pack(capacity, table, stats.docs or 0, stats.mean or 1.0), _PLACED)
    pieces = items.where(F.col("n_pieces") > 1).select("doc_id", "n_pieces", F.posexplode(F.slice("starts", 1, F.col("n_pieces") - 1)).alias("piece", "at"))
    full = pieces.select(
        "doc_id", "piece", "n_pieces", (F.col("piece").cast("bigint") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"),
        F.concat(F.lit("d"), F.coalesce("doc_id", F.lit("")), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.lit(0).alias("slot"),
    )
    none = items.where(F.col("size") == 0).select("doc_id", F.lit(0).alias("piece"), "n_pieces", F.lit(0).cast("bigint").alias("token_start"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"), F.lit(0).alias("slot"))
    return packed.unionByName(full).unionByName(none).withColumn("doc_id", F.col("doc_id").cast(kind))


def packing_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: ``containers, n_tokens, fill`` (share of the containers' room that is used), ``mean_texts``."""
    boxes = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("texts"))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.avg("texts").alias("mean_texts")
    )
