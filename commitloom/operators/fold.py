"""Folding commit x file records into commits, and choosing what stands for a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.instants import date_text, instant_of, to_instant


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all of the columns are neither null nor empty."""
    for c in columns:
        df = df.where(F.coalesce(F.col(c), F.lit("")) != "")
    return df


def with_order(df: DataFrame) -> DataFrame:
    """``ord``: the row's place in the scan, by file and position; stable for unchanged files."""
    return df.withColumn("ord", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("pos")))


def content_order(*columns: str) -> Column:
    """A short order that depends on the columns' values only: the first one, then a digest of all."""
    own = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.struct(own[0].alias("first"), F.md5(F.concat_ws("|", *[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in own])).alias("digest"))


def fold_commits(records: DataFrame, order: Column) -> DataFrame:
    """One row a commit of ``repo, commit_hash, author, date, message, file, patch`` records.

    Scalars come from the commit's first record in ``order``, modifications are all its
    records in that order; keep ``order`` short, as it travels with both. Rows without a
    repository or hash are left out. The state of a commit is one partial aggregate a
    partition; a commit's size is bounded by its files.
    """
    rows = required(records, "repo", "commit_hash").withColumn("__o", order)
    first = F.min_by(F.struct("author", "date", "message"), "__o").alias("__f")
    mods = F.array_sort(F.collect_list(F.struct(F.col("__o").alias("ord"), F.col("file").alias("filename"), F.col("patch").alias("diff"))))
    out = rows.groupBy("repo", "commit_hash").agg(first, mods.alias("__m")).select("repo", "commit_hash", "__f.*", "__m")
    cleaned = text.clean_message_semantic(F.col("message"))
    return out.select(
        F.col("repo").alias("repo_name"), "commit_hash", F.col("message").alias("msg_original"), cleaned.alias("msg_clean"), F.col("author").alias("author_name"),
        to_instant(F.col("date")).alias("author_date"),
        F.transform("__m", lambda m: F.struct(m["filename"].alias("filename"), m["filename"].alias("new_path"), F.lit(None).cast("string").alias("old_path"), m["diff"].alias("diff"))).alias("modifications"),
        text.is_generic_merge(F.col("message"), cleaned).alias("is_merge"),
    )


def _rank(file: Column) -> Column:
    """The place of a file's extension in the order of relevance, 99 for others."""
    place = F.array_position(F.array(*[F.lit(e) for e in paths.EXTENSION_ORDER]), F.coalesce(paths.extension(file), F.lit("")))
    return F.coalesce(F.nullif(place, F.lit(0).cast("bigint")), F.lit(99).cast("bigint"))


def summarise_commits(records: DataFrame, order: Column, lines: int = 10) -> DataFrame:
    """What the steps after folding need of each commit, without its list of files: the scalars of
    :func:`fold_commits`, ``n_files``, ``best`` as :func:`best_modification`, ``relevant, only_vendor, touches_vendor``.

    Every state is small and combined before the shuffle, and of a patch only its first
    ``lines`` travel, so commits of any number of files are as cheap as their records.
    """
    rows = required(records, "repo", "commit_hash").withColumn("__d", date_text(F.col("date")))
    has = F.coalesce(F.col("patch"), F.lit("")) != ""
    best = F.struct(F.when(has, F.col("file")).alias("file"), F.when(has, F.substring_index("patch", "\n", lines)).otherwise("").alias("excerpt"))
    one = F.array("file")  # the predicates on lists of files, for a list of one
    rows = rows.select(
        "repo", "commit_hash", F.struct("author", instant_of(F.col("__d")).alias("author_date"), "message").alias("__f"), best.alias("__b"), _rank(F.col("file")).alias("__r"), order.alias("__o"),
        paths.any_relevant(one).alias("__relevant"), (F.trim(F.coalesce("file", F.lit(""))) != "").alias("__named"), paths.only_vendor(one).alias("__vendor"), paths.touches_vendor(one).alias("__touches"),
    )
    out = rows.groupBy("repo", "commit_hash").agg(
        F.min_by("__f", "__o").alias("__f"), F.min_by("__b", F.struct("__r", "__o")).alias("best"), F.count(F.lit(1)).alias("n_files"), F.bool_or("__relevant").alias("relevant"),
        F.coalesce(F.bool_and(F.when(F.col("__named"), F.col("__vendor"))), F.lit(False)).alias("only_vendor"), F.bool_or("__touches").alias("touches_vendor"),
    ).select("repo", "commit_hash", "__f.*", "best", "n_files", "relevant", "only_vendor", "touches_vendor")
    # A generated column is computed once; as an alias it would be repeated in every filter and column that uses it.
    cleaned = F.inline(F.array(F.struct(text.clean_message_semantic(F.col("message")).alias("msg_clean"))))
    return out.select("*", cleaned).select(
        F.col("repo").alias("repo_name"), "commit_hash", F.col("message").alias("msg_original"), "msg_clean", F.col("author").alias("author_name"), "author_date",
        text.is_generic_merge(F.col("message"), F.col("msg_clean")).alias("is_merge"), "best", "n_files", "relevant", "only_vendor", "touches_vendor",
    )


def best_modification(modifications: Column, lines: int = 10) -> Column:
    """``file, excerpt`` of the modification whose extension ranks highest, the first one on a tie.

    The excerpt is the diff's first lines; a modification without a diff gives no file and an empty excerpt.
    """
    ranks = F.transform(
        modifications,
        lambda m, i: F.struct(
            _rank(m["filename"]).alias("rank"), i.alias("i"), m["filename"].alias("file"), m["diff"].alias("diff"),
        ),
    )
    best = F.array_min(ranks)
    has = F.coalesce(best["diff"], F.lit("")) != ""
    return F.struct(F.when(has, best["file"]).alias("file"), F.when(has, F.array_join(F.slice(F.split(best["diff"], "\n"), 1, lines), "\n")).otherwise("").alias("excerpt"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def files_joined(modifications: Column) -> Column:
    """File names between semicolons, ``unknown_file`` for missing ones."""
    return F.array_join(F.transform(modifications, lambda m: F.coalesce(m["filename"], F.lit("unknown_file"))), ";")


def eligible(commits: DataFrame, require_patch: bool = False) -> DataFrame:
    """Sample rows of the commits (folded or summarised) that are no merges and have a cleaned message and a relevant file."""
    if "modifications" in commits.columns:
        commits = commits.withColumns({"best": best_modification(F.col("modifications")), "relevant": paths.any_relevant(F.transform("modifications", lambda m: m["filename"]))})
    # Relevance first and the cleaned message last, so that the filter below stays one short expression.
    rows = commits.where("relevant").where(~F.col("is_merge")).where(F.col("msg_clean").isNotNull())
    if require_patch:
        rows = rows.where(F.col("best.file").isNotNull() & (F.col("best.excerpt") != ""))
    return rows.select(
        "commit_hash", "repo_name", "msg_clean", F.coalesce("best.file", F.lit("not_extracted")).alias("file"), F.coalesce(F.nullif("best.excerpt", F.lit("")), F.lit("not_extracted")).alias("patch_excerpt"),
        "author_date", F.length("msg_clean").alias("msg_len"),
    )


def project_existing(df: DataFrame, wanted: list[str], fallback: list[str] | None = None) -> DataFrame:
    """Those of the wanted columns that exist, else those of ``fallback``."""
    own = [c for c in wanted if c in df.columns] or [c for c in fallback or [] if c in df.columns]
    return df.select(*own)
