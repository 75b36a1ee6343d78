"""Sentence vectors, their cache, and linear reduction.

The default embedding is hashed TF-IDF, computed on the JVM. Any function from a
pandas Series of texts to a list of vectors can take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tfidf(df: DataFrame, text: Column, dims: int = 1024, out: str = "embedding") -> DataFrame:
    """``df`` with ``out array<double>``: hashed TF-IDF of the text's words, of length 1 (or 0 for empty text)."""
    words = df.withColumn("__w", T.words(F.lower(F.coalesce(text, F.lit("")))))
    counted = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dims).transform(words)
    weighted = IDF(inputCol="__tf", outputCol="__v").fit(counted).transform(counted)
    return Normalizer(inputCol="__v", outputCol="__n", p=2.0).transform(weighted).withColumn(out, vector_to_array("__n")).drop("__w", "__tf", "__v", "__n")


def embed_with(df: DataFrame, text: str, encode: Callable[[pd.Series], list], out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a pluggable encoder, applied to Arrow batches; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in encode(s.fillna(""))])

    return df.withColumn(out, run(F.col(text)))


def embed_cached(df: DataFrame, text: str, cache: str, encode: Callable[[pd.Series], list]) -> DataFrame:
    """As :func:`embed_with`, keeping vectors in a parquet folder by text digest; only texts that it lacks are encoded."""
    spark = df.sparkSession
    keyed = df.withColumn("__h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    texts = keyed.groupBy("__h").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    try:
        known = spark.read.parquet(cache)
    except AnalysisException as e:  # no cache yet; a damaged one fails
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = spark.createDataFrame([], "__h string, embedding array<float>")
    fresh = embed_with(texts.join(known, "__h", "left_anti"), "__t", encode).select("__h", "embedding")
    fresh.write.mode("append").parquet(cache)
    return keyed.join(spark.read.parquet(cache).dropDuplicates(["__h"]), "__h", "left").drop("__h")


def reduce_pca(df: DataFrame, vector: str, k: int = 5, out: str = "reduced") -> DataFrame:
    """``df`` with ``out array<double>``: the first ``k`` principal components (of unit-length vectors).

    A linear stand-in for manifold reduction; signs are fixed by the largest loading.
    """
    rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    rows = Normalizer(inputCol="__v", outputCol="__n").transform(rows)
    model = PCA(k=k, inputCol="__n", outputCol="__p").fit(rows)
    load = model.pc.toArray()
    signs = [1.0 if load[abs(load[:, j]).argmax(), j] >= 0 else -1.0 for j in range(load.shape[1])]
    flip = F.array(*[F.lit(s) for s in signs])
    return model.transform(rows).withColumn(out, F.zip_with(vector_to_array("__p"), flip, lambda a, b: a * b)).drop("__v", "__n", "__p")
