"""Reports: small, ordered rows of lines, composed from aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import draw
from .tokens import term_contexts, top_terms_per_group

RULE = "-" * 63


def noise_sample(df: DataFrame, label: str, key: str, display: str, n: int = 10, max_length: int = 250) -> DataFrame:
    """``key, example`` of up to ``n`` random noise rows."""
    return df.where(F.col(label) == -1).orderBy(draw(F.col(key)), key).limit(n).select(key, T.truncate(F.col(display), max_length).alias("example"))


def cluster_report(df: DataFrame, label: str, key: str, search: str, display: str, stop_words: tuple[str, ...], top: int = 25, with_context: int = 15, examples: int = 10, lemmatise: bool = False) -> DataFrame:
    """``label, section, position, line``: the report's lines in order, noise first.

    Sections: 0 head, 1 terms, 2 contexts (clusters only), 3 samples (noise only), 4 room for notes.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    name = F.when(F.col(label) == -1, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), F.col(label).cast("string")))
    head = sizes.select(label, F.lit(0).alias("section"), F.lit(0).alias("position"), F.concat(name, F.lit(": "), F.col("n").cast("string"), F.lit(" messages ("), T.percent(F.col("share")), F.lit(")")).alias("line"))
    members = df.where(F.col(label) != -1)
    ranked = top_terms_per_group(members, label, T.terms(F.col(search), stop_words, lemmatise), top)
    listed = ranked.select(label, F.lit(1).alias("section"), F.col("rank").alias("position"), F.concat(F.lit("  - "), F.col("term"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    shown = term_contexts(members, label, key, F.col(search), F.col(display), ranked.where(F.col("rank") <= with_context), examples)
    placed = shown.join(ranked.select(label, "term", "rank"), [label, "term"])
    context = placed.select(label, F.lit(2).alias("section"), (F.col("rank") * 1000 + F.col("example_no")).alias("position"), F.concat(F.lit("  "), F.col("term"), F.lit(" ("), F.col("hits").cast("string"), F.lit("): "), F.col("example")).alias("line"))
    noise = noise_sample(df, label, key, display).withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)))
    sample = noise.select(F.lit(-1).cast(dict(df.dtypes)[label]).alias(label), F.lit(3).alias("section"), F.col("__i").alias("position"), F.concat(F.lit('  - "'), F.coalesce("example", F.lit("")), F.lit('"')).alias("line"))
    notes = sizes.where(F.col(label) != -1).select(label, F.lit(4).alias("section"), F.lit(0).alias("position"), F.lit("  Theme: " + "_" * 40).alias("line"))
    return reduce(DataFrame.unionByName, [head, listed, context, sample, notes])


def report_lines(report: DataFrame, label: str) -> Iterator[str]:
    """The lines in order, one partition at a time in the driver's memory."""
    for row in report.orderBy(label, "section", "position").toLocalIterator():
        yield row["line"]


def overview_markdown(overview: DataFrame, extensions: DataFrame) -> str:
    """The corpus overview as Markdown, from its one row and the counts of extensions."""
    r = overview.first()
    n = r.n_commits or 0
    share = lambda x: f"{x / n * 100:.2f}%" if n else "N/A"
    facts = [
        ("Commits", n), ("Repositories", r.n_repos), ("Dates", f"{r.min_date} to {r.max_date}" if r.min_date else "N/A"), ("Mean length", r.msg_len_mean), ("Median length", r.msg_len_median),
        ("P10 / P90", f"{r.msg_len_p10} / {r.msg_len_p90}"), ("With link", share(r.n_urls)), ("With issue", share(r.n_issue_refs)), ("With emoji", share(r.n_emojis)), ("fix", share(r.n_fix)), ("feat", share(r.n_feat)),
    ]
    lines = ["# Corpus overview", "", "| Figure | Value |", "|-|-|", *[f"| {k} | {v} |" for k, v in facts], "", "| Extension | Commits |", "|-|-|"]
    lines += [f"| {e.ext} | {e.n_commits} |" for e in extensions.orderBy(F.desc("n_commits"), "ext").limit(20).collect()]
    return "\n".join(lines) + "\n"


def suggestions_text(suggestions: DataFrame) -> str:
    """Stop-word suggestions as a YAML list, in order."""
    return "custom_stopwords:\n" + "".join(f"  - {r.token}\n" for r in suggestions.orderBy("token").collect())


def bar_counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    """What a bar chart of ``key`` shows: value and count, largest first."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)
