"""Incremental ingestion and event-time windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import is_infra_file
from ..functions.text import has_keyword
from ..schemas import MINED, schema
from ..sources.sinks import append_mined


def infra_fixes(records: DataFrame) -> DataFrame:
    """Records of infrastructure files whose message has a word of correction."""
    return records.where(has_keyword(F.col("message")) & is_infra_file(F.col("file")))


def ingest_jsonl(spark: SparkSession, source: str, target: str, checkpoint: str, only_fixes: bool = False) -> StreamingQuery:
    """Take in all new JSON Lines files below ``source`` and stop.

    Offsets in ``checkpoint`` make every file count once; each batch appends only keys
    that ``target`` lacks, so a batch that is run again after a failure adds nothing.
    """
    rows = spark.readStream.schema(schema(MINED)).option("recursiveFileLookup", True).json(source)
    rows = infra_fixes(rows) if only_fixes else rows
    return rows.writeStream.foreachBatch(lambda df, _: append_mined(df, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, value: Column, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``window_start, key, n, total``: counts and sums by event time, batch or stream; late rows beyond the watermark are dropped by streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def deduplicated(records: DataFrame, keys: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
