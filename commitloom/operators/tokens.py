"""Token and bigram frequencies, coverage, and stop-word suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# English stop words.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does
    doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more
    most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you
    your yours yourself yourselves""".split()
)
# Words of the tools around a commit, and suggestions' word lists.
TOOL_WORDS = ("git", "github", "gitlab", "pull", "request", "branch", "commit", "committed")
MERGE_TERMS = ("merge", "pull", "branch")
DOMAIN_TERMS = tuple(
    """terraform provider helm aws gcp azure kubernetes k8s module resource variable output data release chart value config plugin template service instance
    cluster network bump update version upgrade refactor docs readme chore build test ci lint format""".split()
)
KEEP_TERMS = ("fix", "feat", "use", "change", "remove", "default", "error", "bug", "issue")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """``token, freq`` of an array column."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def top_tokens(counts: DataFrame, n: int = 60) -> DataFrame:
    """The ``n`` most frequent tokens, alphabetical on a tie: a distributed top-n."""
    return counts.orderBy(F.desc("freq"), "token").limit(n)


def token_coverage(counts: DataFrame, n: int = 50) -> DataFrame:
    """One row: occurrences of the ``n`` most frequent tokens, of all, and their ratio."""
    top = top_tokens(counts, n).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("top_freq"))
    total = counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("t")).scalar()
    return top.select("top_freq", total.alias("total_freq"), F.when(total > 0, F.col("top_freq") / total).otherwise(0.0).alias("coverage"))


def bigrams(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Pairs of neighbouring words of two characters or more, after stop words are removed."""
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    own = F.filter(own, lambda t: ~t.isin(*stop_words)) if stop_words else own
    # The one-element array binds the words, so they are extracted once.
    pairs = F.transform(F.array(own), lambda o: F.zip_with(o, F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))
    return F.filter(pairs[0], lambda p: p.isNotNull())


def top_bigrams(df: DataFrame, text: Column, n: int = 20, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``bigram, n`` of the most frequent pairs, alphabetical on a tie; without stop words removed if nothing is left."""
    def counted(stops: tuple[str, ...]) -> DataFrame:
        return df.select(F.explode(bigrams(text, stops)).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))

    counts = counted(stop_words)
    if stop_words and counts.isEmpty():
        counts = counted(())
    return counts.orderBy(F.desc("n"), "bigram").limit(n)


def stop_word_suggestions(top: DataFrame, n_messages: Column, bigram_list: DataFrame | None = None) -> DataFrame:
    """``token`` of everything worth stopping: merge terms, domain terms among the top tokens, tokens in over 1 % of messages, and bigrams."""
    frequent = (F.col("freq") > 0.01 * n_messages) & (F.length("token") > 2) & ~F.col("token").isin(*KEEP_TERMS)
    out = top.where(F.col("token").isin(*DOMAIN_TERMS) | frequent).select("token")
    fixed = top.sparkSession.createDataFrame([(t,) for t in MERGE_TERMS], "token string")
    out = out.unionByName(fixed)
    if bigram_list is not None:
        out = out.unionByName(bigram_list.select(F.col("bigram").alias("token")))
    return out.select(F.lower("token").alias("token")).distinct()


def parse_suggestions(phrases: DataFrame, column: str) -> DataFrame:
    """``token`` of the words of suggested phrases, without single characters and numbers."""
    return phrases.select(F.explode(T.words(F.lower(column))).alias("token")).where(r"length(token) > 1 AND NOT token RLIKE '^[0-9]+$'").distinct()


def top_terms_per_group(df: DataFrame, group: str, terms: Column, n: int = 25) -> DataFrame:
    """``group, term, n, rank`` of each group's most frequent terms, alphabetical on a tie.

    Counts are combined by (group, term) first; ranks are limited while sorting.
    """
    counts = df.select(group, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def term_contexts(df: DataFrame, group: str, key: str, search: Column, display: Column, top: DataFrame, examples: int = 10, max_length: int = 400) -> DataFrame:
    """``group, term, hits, example_no, example``: texts of the group that contain each top term, highlighted and truncated.

    The terms of a group are few; they meet its texts in one pass: every text lists the
    words it has, and those are joined with the terms as starts of words.
    """
    rows = df.select(group, F.col(key).alias("__k"), search.alias("__s"), display.alias("__d"))
    per = top.groupBy(group).agg(F.collect_set("term").alias("__terms"))
    hits = rows.join(per, group).select(
        group, "__k", "__d", F.explode(F.filter("__terms", lambda t: F.regexp_like(F.coalesce(F.col("__s"), F.lit("")), F.concat(F.lit(r"(?i)\b"), F.regexp_replace(t, r"([-.+])", r"\\$1"))))).alias("term")
    )
    rn = F.row_number().over(Window.partitionBy(group, "term").orderBy("__k"))
    counted = hits.groupBy(group, "term").agg(F.count(F.lit(1)).alias("hits"))
    shown = hits.withColumn("example_no", rn).where(F.col("example_no") <= examples)
    return shown.join(counted, [group, "term"]).select(group, "term", "hits", "example_no", T.truncate(T.highlight(F.col("__d"), F.col("term")), max_length).alias("example"))
