"""Unified diffs as rows of lines, with Terraform meaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Lines of an Arrow batch that leaves :func:`diff_lines`.
_OUT = 1 << 16


def _number(texts: pa.Array) -> tuple[np.ndarray, pa.RecordBatch]:
    """(row of each line, ``line_no, change, content, old_lineno, new_lineno``) of the lines of not empty patches, with whole-column kernels only."""
    split = pc.split_pattern(texts, "\n")
    per = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = split.flatten()
    row = np.repeat(np.arange(len(per)), per)
    first = np.cumsum(per) - per
    at = np.arange(len(lines))

    def starts(prefix: str) -> np.ndarray:
        return pc.starts_with(lines, prefix).to_numpy(zero_copy_only=False)

    header = starts("@@")
    # The line of the last header up to each line; below the text's first line where there is none.
    last = np.maximum.accumulate(np.where(header, at, -1)) if len(at) else at
    inside = (last >= first[row]) & ~header
    plus, minus = inside & starts("+"), inside & starts("-")
    other = inside & ~plus & ~minus & ~starts("\\")
    heads = lines.filter(pa.array(header))

    def numbers(pattern: str, counted: np.ndarray) -> pa.Array:
        """The header's number and the lines counted since."""
        found = pc.struct_field(pc.extract_regex(heads, pattern), "n")
        base = np.zeros(len(lines), dtype=np.int64)
        base[header] = pc.fill_null(pc.cast(found, pa.int64()), 1).to_numpy(zero_copy_only=False) - 1
        total = np.cumsum(counted)
        safe = np.maximum(last, 0)
        return pa.array(base[safe] + total - total[safe], mask=~counted).cast(pa.int32())

    old, new = numbers(r"^@@ -(?P<n>\d{1,9})", minus | other), numbers(r"^@@ -\S+ \+(?P<n>\d{1,9})", plus | other)
    change = pa.DictionaryArray.from_arrays(pa.array(np.where(plus, 0, np.where(minus, 1, 2)).astype(np.int8)), pa.array(["added", "removed", "other"])).cast(pa.string())
    content = pc.if_else(pa.array(plus | minus | other), pc.utf8_slice_codeunits(lines, 1), lines)
    number = pa.array((at - first[row] + 1).astype(np.int32))
    return row, pa.RecordBatch.from_arrays([number, change, content, old, new], names=["line_no", "change", "content", "old_lineno", "new_lineno"])


def diff_lines(df: DataFrame, patch: str = "patch", keep: list[str] | None = None) -> DataFrame:
    """One row per line of each patch: ``keep``, ``line_no, change, content, old_lineno, new_lineno``.

    ``change`` is added, removed or other; headers are other. Line numbers follow the
    hunk headers: removed lines have the old number, added lines the new one, context
    lines both. Null and empty patches give no rows. Line numbers are running sums within
    a row, which no built-in expression forms in linear time; they are taken over whole
    Arrow batches, so nothing is shuffled and a patch may have any number of lines.
    """
    kept = keep if keep is not None else [c for c in df.columns if c != patch]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1)
            row, rows = _number(texts.cast(pa.large_string()))
            rows = rows.set_column(2, "content", rows.column(2).cast(pa.large_string()))
            for i in range(0, rows.num_rows, _OUT):
                part = rows.slice(i, _OUT)
                own = batch.select(list(range(batch.num_columns - 1))).take(pa.array(row[i : i + _OUT]))
                columns = [part.column(k).cast(pa.string()) if k == 2 else part.column(k) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*kept, *rows.schema.names])

    by_name = {f.name: f for f in df.schema.fields}
    out = T.StructType([*(by_name[k] for k in kept), *T.StructType.fromDDL("line_no int, change string, content string, old_lineno int, new_lineno int").fields])
    rows = df.where(F.coalesce(F.length(patch), F.lit(0)) > 0).select(*kept, F.col(patch).alias("__patch"))
    return rows.mapInArrow(run, out)


def enrich(lines: DataFrame) -> DataFrame:
    """``resource_type`` of a line that opens a resource, ``attr_name`` of one that sets an attribute; null elsewhere."""
    opened = F.regexp_extract("content", r'^\s*(?:resource|data)\s+"([^"]+)"\s+"[^"]+"', 1)
    name = F.regexp_extract("content", r"^\s*([A-Za-z_][\w-]*)\s*=(?!=)", 1)
    return lines.withColumns({"resource_type": F.nullif(opened, F.lit("")), "attr_name": F.nullif(name, F.lit(""))})


def swap_sides(lines: DataFrame) -> DataFrame:
    """Lines of diffs that were taken from the commit to its parent, turned round."""
    change = F.when(F.col("change") == "added", "removed").when(F.col("change") == "removed", "added").otherwise(F.col("change"))
    return lines.withColumns({"change": change, "old_lineno": F.col("new_lineno"), "new_lineno": F.col("old_lineno")})


def patch_kind(patch: Column) -> Column:
    """``diff`` for hunks, ``content`` for whole files, ``empty`` for nothing."""
    return F.when(F.coalesce(F.length(patch), F.lit(0)) == 0, "empty").when(patch.rlike(r"(?m)^@@ "), "diff").otherwise("content")


def line_stats(lines: DataFrame, repo: str, commit: str, file: str) -> DataFrame:
    """One row: distinct repositories, commits, files and resource types, and lines by kind."""
    return lines.agg(
        F.count_distinct(repo).alias("n_repos"), F.count_distinct(commit).alias("n_commits"), F.count_distinct(file).alias("n_files"), F.count_distinct("resource_type").alias("n_resource_types"),
        F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"), F.count(F.lit(1)).alias("n_lines"),
    )
