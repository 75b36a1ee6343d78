"""Writers of the engine's file formats."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators.records import new_only


#: Folders that appended records are dealt to by a hash of their key.
PARTS = 64


def append_mined(new: DataFrame, path: str, keys: list[str] = ["repo", "commit_hash", "file"], parts: int = PARTS) -> int:  # noqa: B006
    """Append the records that a parquet folder lacks; returns how many. Repeating it adds nothing.

    The folder is partitioned by ``part``, a hash of the key, so only the parts that the
    new records fall into are read, and of them only the key columns.
    """
    spark = new.sparkSession
    new = new.drop("part").dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:  # the folder does not exist yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        old = None
    if old is not None:
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts``
        new = new_only(new, old.where(F.col("part").isin(touched)).select("part", *keys), ["part", *keys])
    fresh = new.persist()
    n = fresh.count()
    if n:
        fresh.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    fresh.unpersist()
    return n


def write_jsonl(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """JSON Lines, times with their offset, optionally one folder per value of ``by``."""
    w = df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd HH:mm:ssxx").option("ignoreNullFields", "false")
    (w.partitionBy(by) if by else w).json(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = True, by: str | None = None) -> None:
    """CSV with a header, all fields quoted by default, quotes doubled."""
    w = df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"')
    (w.partitionBy(by) if by else w).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_lines(lines: Iterable[str], path: str) -> None:
    """A text file, written line by line."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("w", encoding="utf-8") as f:
        for line in lines:
            f.write(line + "\n")


def write_bigrams(df: DataFrame, path: str) -> None:
    """``[[bigram, n], ...]`` as one JSON document with numbers; the list is a top-k."""
    rows = [[r.bigram, r.n] for r in df.orderBy(F.desc("n"), "bigram").collect()]
    write_lines([json.dumps(rows, ensure_ascii=False)], path)


def write_markdown_table(df: DataFrame, path: str) -> None:
    """A small table as Markdown, in its order."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    write_lines([*head, *("| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.toLocalIterator())], path)
