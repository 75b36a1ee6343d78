"""Readers of the engine's file formats."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANNOTATION, CLUSTERED, MINED, schema


def read_mined(spark: SparkSession, pattern: str) -> DataFrame:
    """Mined records of JSON Lines files (``DIR/*/data.jsonl``); lines that are no JSON object are left out."""
    with_bad = schema(MINED + ", _bad STRING")
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, quoted fields over several lines and doubled quotes; all columns are strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    return df.select(*columns) if columns else df


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotator's table: ``commit_URL, is_bugfix, obs``."""
    return read_csv(spark, path, [f.name for f in schema(ANNOTATION).fields])


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clustered commits of JSON Lines."""
    return spark.read.schema(schema(CLUSTERED)).json(path)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """``bigram, n`` of a JSON list of pairs or of texts (n is null then); files are small."""
    data = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    rows = [(x, None) if isinstance(x, str) else (x[0], int(x[1]) if len(x) > 1 else None) for x in data]
    return spark.createDataFrame(rows, "bigram string, n bigint")


def load_yaml(path: str, required: bool = False) -> dict[str, Any]:
    """A YAML file as a dict; a missing one gives an empty dict, or FileNotFoundError if it is required."""
    import yaml

    p = Path(path)
    if not p.exists():
        if required:
            raise FileNotFoundError(path)
        return {}
    return yaml.safe_load(p.read_text(encoding="utf-8")) or {}


def load_stop_words(path: str) -> tuple[str, ...]:
    """The words of suggested phrases (``custom_stopwords``), without single characters and numbers."""
    phrases = load_yaml(path).get("custom_stopwords") or []
    words = {w.lower() for p in phrases for w in str(p).split()}
    return tuple(sorted(w for w in words if len(w) > 1 and not w.isdigit()))
