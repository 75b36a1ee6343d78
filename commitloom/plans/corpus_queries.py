"""Queries over the whole tables for the operators of the corpus engine, with SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.instants import to_instant
from ..config import settings
from ..lineage import ensure_checkpoint_dir
from ..operators import density, diff, embed, fold, hcl, records, report, sampling, stats, tokens
from ..sources import connectors
from ..sources.tables import table
from ..streaming.ingest import windowed_counts
from . import pipelines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mined_data").where("message IS NOT NULL").select("message").distinct()


def _list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_FIRST = r"regexp_split_to_array(message, '\r\n|\n|\r')[1]"
_MESSAGES = "(SELECT DISTINCT message FROM mined_data WHERE message IS NOT NULL) m"


def _tidy_sql(line: str, unicode: bool = False) -> str:
    space, visible = (r"[\s\x0b\x{85}\p{Z}]", r"[^\s\x0b\x{85}\p{Z}]") if unicode else (r"\s", r"\S")
    t = rf"trim(regexp_replace(regexp_replace(lower(regexp_replace({line}, '({space}|^)(#|GH-)\d+\b', ' ', 'g')), 'https?://{visible}+', ' ', 'g'), '{space}+', ' ', 'g'))"
    return f"nullif(CASE WHEN length({t}) > 150 THEN regexp_replace({t}[1:150], ' [^ ]*$', '') ELSE {t} END, '')"


# ---- messages


@_query(f"SELECT message, {_tidy_sql(_FIRST)} AS msg_clean FROM {_MESSAGES}")
def clean_message(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("message", text.clean_message(F.col("message"), unicode=False).alias("msg_clean"))


@_query(rf"""
    SELECT message, regexp_replace(lower({_FIRST}), '^\s+|\s+$', '', 'g') AS basic, regexp_matches(message, 'https?://\S+') AS has_url,
        regexp_matches(message, '(\s|^)(#|GH-)\d+\b') AS has_issue, basic LIKE 'fix:%' OR basic LIKE 'fix(%' AS is_fix, basic LIKE 'feat:%' OR basic LIKE 'feat(%' AS is_feat
    FROM {_MESSAGES}""")
def clean_basic_flags(spark: SparkSession, d: str) -> DataFrame:
    basic = text.clean_basic(F.col("message"), unicode=False)
    return _messages(spark, d).select(
        "message", basic.alias("basic"), text.has_url(F.col("message")).alias("has_url"), text.has_issue_ref(F.col("message")).alias("has_issue"),
        text.has_prefix(basic, "fix").alias("is_fix"), text.has_prefix(basic, "feat").alias("is_feat"),
    )


@_query(f"""
    SELECT repo, count(*) AS n_records, count(DISTINCT commit_hash) AS n_commits FROM mined_data
    WHERE {" OR ".join(f"contains(lower(message), '{k}')" for k in text.FIX_KEYWORDS)} GROUP BY 1""")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mined_data").where(text.has_keyword(F.col("message")))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("commit_hash").alias("n_commits"))


@_query(rf"SELECT message, regexp_matches(message, '(?i)^(?:{'|'.join(text.MERGE_FORMS).replace(chr(39), chr(39) * 2)})') AS is_merge FROM {_MESSAGES}")
def merge_flags(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("message", text.is_merge(F.col("message")).alias("is_merge"))


def _content_sql() -> str:
    quoted = ["(?s)" + f.replace("'", "''") for f in text.MERGE_CONTENT]
    cases = []
    for q, two in zip(quoted, (True, False, False)):
        branch = rf"trim(regexp_replace(regexp_replace(regexp_extract(message, '{q}', 1), '[-_]+', ' ', 'g'), '[^\w\s]', ' ', 'g'))"
        title = rf"regexp_replace(regexp_extract(message, '{q}', 2), '^\s+|\s+$', '', 'g')" if two else "''"
        cases.append(f"WHEN regexp_matches(message, '{q}') THEN CASE WHEN {title} <> '' AND lower({title}) <> lower({branch}) THEN concat_ws(' ', {branch}, {title}) WHEN {title} <> '' THEN {title} ELSE {branch} END")
    return "CASE " + " ".join(cases) + " END"


@_query(f"SELECT message, {_content_sql()} AS content FROM {_MESSAGES}")
def merge_semantics(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("message", text.merge_content(F.col("message"), unicode=False).alias("content"))


@_query(rf"SELECT regexp_matches(message, '(?i)\b(fix|bug|resolv|crash|error|issue|incorrect)') AS is_bugfix, count(*) AS n FROM {_MESSAGES} GROUP BY 1")
def bugfix_classifier(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).groupBy(text.is_bugfix(F.col("message")).alias("is_bugfix")).agg(F.count(F.lit(1)).alias("n"))


def _language_sql(value: str) -> str:
    """The language of a text: most frequent words, the first language on a tie."""
    hits = {k: f"len(list_filter(regexp_extract_all(lower({value}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains([{_list(ws)}], w)))" for k, ws in text.LANGUAGE_WORDS.items()}
    names = list(hits)
    cases = " ".join(f"WHEN l.{k} >= greatest({', '.join('l.' + n for n in names[i + 1:])}) THEN '{k}'" for i, k in enumerate(names[:-1]))
    packed = ", ".join(f"'{k}': {h}" for k, h in hits.items())
    return f"(SELECT CASE WHEN {value} IS NULL THEN NULL {cases} ELSE '{names[-1]}' END FROM (SELECT {{{packed}}} AS l) q)"


@_query(f"SELECT lang, {_language_sql('text')} AS detected, count(*) AS n FROM documents GROUP BY 1, 2")
def message_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", text.language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


_UNICODE_WORDS = r"list_filter(regexp_split_to_array(coalesce(message, ''), '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '')"


@_query(f"""
    WITH t AS (SELECT message, {_tidy_sql(f"coalesce(nullif({_content_sql()}, ''), {_FIRST})", True)} AS semantic FROM {_MESSAGES})
    SELECT message, semantic, len({_UNICODE_WORDS}) AS n_words, CASE WHEN length(message) > 40 THEN message[1:40] || '...' ELSE message END AS short,
        printf('%.2f%%', 100.0 * len({_UNICODE_WORDS}) / 97) AS density FROM t""")
def message_measures(spark: SparkSession, d: str) -> DataFrame:
    m, n = F.col("message"), text.word_count(F.col("message"))
    return _messages(spark, d).select("message", text.clean_message_semantic(m).alias("semantic"), n.cast("bigint").alias("n_words"), text.truncate(m, 40).alias("short"), text.percent(n / 97).alias("density"))


# ---- paths

_PATH = r"regexp_replace(lower(regexp_replace(replace(file, '\', '/'), '/+', '/', 'g')), '^/|/$', '', 'g')"


@_query(rf"""
    WITH f AS (SELECT DISTINCT file FROM mined_data WHERE file IS NOT NULL), p AS (SELECT file, {_PATH} AS path FROM f), q AS (SELECT *, string_split(path, '/') AS parts FROM p)
    SELECT file, path, lower(regexp_extract(string_split(file, '/')[-1], '^.+(\.[^.]*)$', 1)) AS ext,
        NOT parts[-1] IN ({_list(paths.SIDE_FILES)}) AND NOT list_has_any(parts[:-2], [{_list(paths.SIDE_DIRS)}]) AND parts[-1] LIKE '%.tf' AS is_infra FROM q""")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "mined_data").where("file IS NOT NULL").select("file").distinct()
    return files.select("file", paths.normalise(F.col("file")).alias("path"), paths.extension(F.col("file")).alias("ext"), paths.is_infra_file(F.col("file")).alias("is_infra"))


@_query(rf"""
    SELECT repo, commit_hash, coalesce(bool_or(NOT regexp_matches(file, '(?i)(?:{"|".join(paths.EXCLUDED_PATTERNS)})')), false) AS relevant,
        coalesce(bool_and(trim(file) LIKE 'vendor/%') FILTER (trim(file) <> ''), false) AS only_vendor, coalesce(bool_or(regexp_matches(file, '(?i)vendor/')), false) AS touches_vendor
    FROM mined_data WHERE repo <> '' AND commit_hash <> '' GROUP BY 1, 2""")
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).select(F.col("repo_name").alias("repo"), "commit_hash", "relevant", "only_vendor", "touches_vendor")


@_query("""
    SELECT repo, concat_ws('_', string_split(repo, '/')[1], string_split(repo, '/')[2][1:50], md5(repo)[1:8]) AS directory
    FROM (SELECT DISTINCT repo FROM clone_summary WHERE repo IS NOT NULL) c""")
def clone_directories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clone_summary").where("repo IS NOT NULL").select("repo").distinct().select("repo", paths.clone_directory(F.col("repo")).alias("directory"))


# ---- commits

_FIELDS = ("file", "patch", "message", "date", "author")
_DIGEST = "md5(" + " || '|' || ".join(f"length(coalesce({c}, ''))::VARCHAR || ':' || coalesce({c}, '')" for c in _FIELDS) + ")"
_ORD = f"(coalesce(file, ''), {_DIGEST})"


def _order() -> Column:
    return fold.content_order(*_FIELDS)


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return fold.summarise_commits(table(spark, d, "mined_data"), _order())


_RANK = "CASE lower(regexp_extract(string_split(coalesce(file, ''), '/')[-1], '^.+(\\.[^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN {i + 1}" for i, e in enumerate(paths.EXTENSION_ORDER)) + " ELSE 99 END"
_KEYED = "mined_data WHERE repo <> '' AND commit_hash <> ''"


@_query(f"""
    SELECT repo AS repo_name, commit_hash, arg_min(coalesce(message, '?'), {_ORD}) AS msg_original, count(*) AS n_files,
        string_agg(coalesce(file, 'unknown_file'), ';' ORDER BY {_ORD}) AS files
    FROM {_KEYED} GROUP BY 1, 2""")
def fold_commits(spark: SparkSession, d: str) -> DataFrame:
    folded = fold.fold_commits(table(spark, d, "mined_data"), _order())
    return folded.select(
        "repo_name", "commit_hash", F.coalesce("msg_original", F.lit("?")).alias("msg_original"), F.size("modifications").cast("bigint").alias("n_files"), fold.files_joined(F.col("modifications")).alias("files")
    )


@_query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY {_RANK}, coalesce(file, ''), {_DIGEST}) AS rn FROM {_KEYED})
    SELECT repo AS repo_name, commit_hash, CASE WHEN coalesce(patch, '') <> '' THEN file END AS file,
        CASE WHEN coalesce(patch, '') <> '' THEN array_to_string(string_split(patch, chr(10))[1:10], chr(10)) ELSE '' END AS excerpt FROM r WHERE rn = 1""")
def best_modification(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).select("repo_name", "commit_hash", "best.file", "best.excerpt")


@_query(f"""
    SELECT repo, commit_hash, file, date FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY coalesce(file, ''), coalesce(patch, ''), coalesce(date, ''), coalesce(head_hash, '')) AS rn FROM {_KEYED}) t WHERE rn = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = fold.required(table(spark, d, "mined_data"), "repo", "commit_hash")
    return fold.keep_first(rows, ["repo", "commit_hash"], [F.coalesce(c, F.lit("")) for c in ("file", "patch", "date", "head_hash")]).select("repo", "commit_hash", "file", "date")


_INSTANT = "coalesce(try_strptime(regexp_replace(trim(date), 'Z$', '+00:00'), '%Y-%m-%dT%H:%M:%S%z'), try_strptime(trim(date), '%Y-%m-%d %H:%M:%S %z'), try_strptime(trim(date), '%a %b %d %H:%M:%S %Y %z'))"
_MERGE = rf"regexp_matches(message, '(?i)^(?:{'|'.join(text.MERGE_FORMS).replace(chr(39), chr(39) * 2)})')"
_RELEVANT = f"coalesce(bool_or(NOT regexp_matches(file, '(?i)(?:{'|'.join(paths.EXCLUDED_PATTERNS)})')), false)"
#: One row a commit: its first record's message, cleaned, and date, and what its files say.
_FOLDED = f"""
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY coalesce(file, ''), {_DIGEST}) AS rn FROM {_KEYED}) t WHERE rn = 1),
    told AS (SELECT *, coalesce(nullif({_content_sql()}, ''), {_FIRST}) AS line FROM first),
    cleaned AS (SELECT *, {_tidy_sql("line", True)} AS msg_clean FROM told),
    per AS (SELECT repo, commit_hash, {_RELEVANT} AS relevant, coalesce(bool_and(trim(file) LIKE 'vendor/%') FILTER (trim(file) <> ''), false) AS only_vendor,
        coalesce(bool_or(regexp_matches(file, '(?i)vendor/')), false) AS touches_vendor FROM {_KEYED} GROUP BY 1, 2),
    folded AS (SELECT c.repo, c.commit_hash, message, msg_clean, {_INSTANT} AS ts, coalesce({_MERGE}, false) AND (coalesce(msg_clean, '') = '' OR regexp_matches(msg_clean, '^merge (?:pull request|branch)')) AS is_merge,
        relevant, only_vendor, touches_vendor FROM cleaned c JOIN per USING (repo, commit_hash))"""
_BEST = f"""
    best AS (SELECT repo, commit_hash, CASE WHEN coalesce(patch, '') <> '' THEN file END AS file, CASE WHEN coalesce(patch, '') <> '' THEN array_to_string(string_split(patch, chr(10))[1:10], chr(10)) ELSE '' END AS excerpt
        FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY {_RANK}, coalesce(file, ''), {_DIGEST}) AS rn FROM {_KEYED}) r WHERE rn = 1)"""


@_query(f"""
    WITH {_FOLDED}, {_BEST} SELECT commit_hash, repo AS repo_name, msg_clean, coalesce(b.file, 'not_extracted') AS file, coalesce(nullif(b.excerpt, ''), 'not_extracted') AS patch_excerpt,
        ts AT TIME ZONE 'UTC' AS author_date, length(msg_clean) AS msg_len FROM folded JOIN best b USING (repo, commit_hash) WHERE NOT is_merge AND msg_clean IS NOT NULL AND relevant""")
def eligible_commits(spark: SparkSession, d: str) -> DataFrame:
    rows = fold.eligible(_commits(spark, d))
    return rows.withColumn("author_date", F.col("author_date").cast("timestamp_ntz"))


@_query(f"""
    WITH {_FOLDED} SELECT count(*) AS n_commits, count(*) FILTER (is_merge) AS n_generic_merges, count(*) FILTER (only_vendor) AS n_only_vendor, count(*) FILTER (touches_vendor) AS n_touch_vendor,
        count(*) FILTER (regexp_matches({_FIRST}, '\\p{{L}}') AND {_language_sql(_FIRST)} <> 'en') AS n_non_english FROM folded""")
def commit_traits(spark: SparkSession, d: str) -> DataFrame:
    return stats.commit_traits(_commits(spark, d))


@_query("""
    WITH old AS (SELECT * FROM mined_data WHERE repo < 'm'), fresh AS (
        SELECT * FROM mined_data n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.commit_hash IS NOT DISTINCT FROM n.commit_hash AND o.file IS NOT DISTINCT FROM n.file))
    SELECT coalesce(repo, '') AS repo, count(*) AS n, count(DISTINCT file) AS n_files FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) t GROUP BY 1""")
def append_new(spark: SparkSession, d: str) -> DataFrame:
    mined = table(spark, d, "mined_data")
    both = records.append_new(mined.where("repo < 'm'"), mined)
    return both.groupBy(F.coalesce("repo", F.lit("")).alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"))


@_query("SELECT DISTINCT commit_hash FROM mined_data WHERE commit_hash <> '' AND NOT commit_hash IN (SELECT commit_hash FROM mined_data WHERE repo < 'm' AND commit_hash IS NOT NULL)")
def unseen_commits(spark: SparkSession, d: str) -> DataFrame:
    mined = table(spark, d, "mined_data")
    return records.new_only(mined.where("commit_hash <> ''").select("commit_hash").distinct(), mined.where("repo < 'm'").select("commit_hash"), ["commit_hash"])


@_query("""
    WITH c AS (SELECT lower(repo) AS repo, stars, commits FROM clone_summary WHERE repo IS NOT NULL), l AS (
        SELECT *, 0 AS priority FROM c WHERE stars >= 1500 UNION ALL SELECT *, 1 FROM c WHERE commits >= 300 UNION ALL SELECT *, 2 FROM c)
    SELECT repo, stars, commits, priority FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority, coalesce(stars, -1) DESC, coalesce(commits, -1) DESC) AS rn FROM l) t WHERE rn = 1""")
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "clone_summary").where("repo IS NOT NULL").select(F.lower("repo").alias("repo"), "stars", "commits")
    order = [F.coalesce("stars", F.lit(-1)).desc(), F.coalesce("commits", F.lit(-1)).desc()]
    return records.priority_union([c.where("stars >= 1500"), c.where("commits >= 300"), c], "repo", order)


@_query("""
    SELECT repo, stars, commits FROM clone_summary WHERE NOT contains(lower(repo), 'demo') AND NOT contains(lower(repo), 'platform')
        AND coalesce(stars, 0) >= 500 AND coalesce(commits, 0) >= 100""")
def repository_filters(spark: SparkSession, d: str) -> DataFrame:
    return records.repository_filter(table(spark, d, "clone_summary").where("repo IS NOT NULL"), "repo", "stars", "commits", 500, 100, ("demo", "platform")).select("repo", "stars", "commits")


@_query("""
    SELECT repo, max(stars) AS stars FROM clone_summary WHERE repo IS NOT NULL AND stars IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_repositories(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "clone_summary").where("repo IS NOT NULL AND stars IS NOT NULL").groupBy("repo").agg(F.max("stars").alias("stars"))
    return records.top_by(best, "stars", 10, "repo")


@_query("SELECT count(*) AS attempted, count(*) FILTER (status IS DISTINCT FROM 'clone_failed') AS started, count(*) FILTER (coalesce(commits, 0) > 0) AS with_rows FROM clone_summary")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.status_counts(table(spark, d, "clone_summary"), F.col("status"), "clone_failed", F.col("commits"))


@_query("""
    SELECT count(*) AS total_repositories_found, count(*) AS total_repositories_attempted, count(*) FILTER (status IS DISTINCT FROM 'clone_failed') AS total_repositories_successful_clone,
        count(*) FILTER (coalesce(commits, 0) > 0) AS total_repositories_commits_mined_at_least_one, sum(commits)::BIGINT AS total_commits,
        (SELECT string_agg(repo || ':' || stars, ';' ORDER BY stars DESC, repo) FROM (SELECT repo, stars FROM clone_summary WHERE repo IS NOT NULL ORDER BY coalesce(stars, -1) DESC, repo LIMIT 10) t) AS top_repositories,
        (SELECT string_agg(s || ':' || n, ';' ORDER BY s) FROM (SELECT coalesce(status, 'unknown') AS s, count(*) AS n FROM clone_summary WHERE repo IS NOT NULL GROUP BY 1) x) AS statuses, 'limit=50;stars=10' AS parameters
    FROM clone_summary WHERE repo IS NOT NULL""")
def mining_summary(spark: SparkSession, d: str) -> DataFrame:
    one = records.mining_summary(table(spark, d, "clone_summary").where("repo IS NOT NULL"), "repo", "stars", "status", "commits", {"stars": 10, "limit": 50})
    pairs = lambda c, k, v, by: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit(by), x[v].cast("string"))), ";")
    return one.select(
        *[c for c in one.columns if c.startswith("total_")], pairs("top_repositories_by_stars", "repo", "stars", ":").alias("top_repositories"), pairs("statuses", "status", "n", ":").alias("statuses"), pairs("parameters", "name", "value", "=").alias("parameters")
    )


@_query("SELECT repo, count(*) AS attempts, max(status) AS status, coalesce(max(commits), 0) AS mined_commits FROM clone_summary WHERE repo IS NOT NULL GROUP BY 1")
def processed_repositories(spark: SparkSession, d: str) -> DataFrame:
    return records.processed_repositories(table(spark, d, "clone_summary"), "repo", "status", "commits")


@_query(f"""
    SELECT repo, arg_max(head_hash, (coalesce(epoch_us({_INSTANT}), -9e18::BIGINT), head_hash)) AS last_head, max({_INSTANT}) AT TIME ZONE 'UTC' AS last_updated, count(DISTINCT commit_hash) AS total_commits_processed
    FROM mined_data WHERE repo <> '' AND head_hash IS NOT NULL GROUP BY 1""")
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    return connectors.resume_points(table(spark, d, "mined_data")).withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@_query("""
    SELECT DISTINCT repo, 'https://code.example/' || split_part(repo, '_', 1) || '/' || split_part(repo, '_', 2) AS repo_url,
        '=HYPERLINK("https://code.example/' || split_part(repo, '_', 1) || '/' || split_part(repo, '_', 2) || '/commit/' || commit_hash || '")' AS link
    FROM mined_data WHERE repo <> '' AND commit_hash <> ''""")
def commit_links(spark: SparkSession, d: str) -> DataFrame:
    url, link = records.repository_urls(F.col("repo"), F.col("commit_hash"), "https://code.example")
    return fold.required(table(spark, d, "mined_data"), "repo", "commit_hash").select("repo", url.alias("repo_url"), link.alias("link")).distinct()


_PLAIN = r"upper(regexp_replace(is_bugfix, '^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$', '', 'g'))"
_LABEL = f"CASE WHEN {_PLAIN} IN ({_list(records.YES)}) THEN true WHEN {_PLAIN} IN ({_list(records.NO)}) THEN false END"
_SAMPLES = " UNION ALL ".join(f"SELECT '{a}' AS annotator, * FROM sample_{a}" for a in ("heleno", "isadora", "vania", "joao"))


@_query(f"""
    SELECT annotator, coalesce(({_LABEL})::VARCHAR, 'open') AS label, count(*) AS n, count(DISTINCT commit_URL) AS n_urls FROM ({_SAMPLES}) s GROUP BY 1, 2""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for a in ("heleno", "isadora", "vania", "joao"):
        own = table(spark, d, f"sample_{a}").withColumn("annotator", F.lit(a))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("annotator", F.coalesce(records.label_value(F.col("is_bugfix")).cast("string"), F.lit("open")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("commit_URL").alias("n_urls"))


@_query("SELECT DISTINCT commit_hash FROM mined_data UNION SELECT DISTINCT regexp_extract(lower(commit_URL), '/commits?/([0-9a-f]{40})', 1) FROM sample_heleno")
def seen_union(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "sample_heleno").select(F.regexp_extract(F.lower("commit_URL"), "/commits?/([0-9a-f]{40})", 1).alias("commit_hash"))
    return records.seen_union(table(spark, d, "mined_data"), labelled, "commit_hash")


@_query(f"""
    WITH {_FOLDED} SELECT repo AS repo_name, commit_hash, msg_clean FROM folded WHERE NOT is_merge AND msg_clean IS NOT NULL AND relevant
        AND (repo, commit_hash) IN (SELECT (repo, commit_hash) FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY {_RANK}, coalesce(file, ''), {_DIGEST}) AS rn FROM {_KEYED}) r WHERE rn = 1 AND coalesce(patch, '') <> '' AND file IS NOT NULL)""")
def clustering_input(spark: SparkSession, d: str) -> DataFrame:
    """Commits to cluster: no merges, with a relevant file and a patch."""
    return pipelines.clustering_input(_commits(spark, d), settings(require_patch=True)).select("repo_name", "commit_hash", "msg_clean")


# ---- statistics


@_query(rf"""
    WITH b AS (SELECT *, regexp_replace(lower(coalesce(regexp_split_to_array(text, '\r\n|\n|\r')[1], '')), '^\s+|\s+$', '', 'g') AS basic FROM documents)
    SELECT count(*) AS n_commits, count(DISTINCT source) AS n_repos, min(created_at AT TIME ZONE 'UTC') AS min_date, max(created_at AT TIME ZONE 'UTC') AS max_date, round_even(avg(length(basic)), 2) AS msg_len_mean,
        round_even(quantile_cont(length(basic), 0.5), 2) AS msg_len_median, round_even(quantile_cont(length(basic), 0.1), 2) AS msg_len_p10, round_even(quantile_cont(length(basic), 0.9), 2) AS msg_len_p90,
        count(*) FILTER (regexp_matches(text, 'https?://\S+')) AS n_urls, count(*) FILTER (regexp_matches(text, '(\s|^)(#|GH-)\d+\b')) AS n_issue_refs,
        count(*) FILTER (regexp_matches(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2B50}}\x{{2B55}}\x{{231A}}\x{{231B}}\x{{23E9}}-\x{{23FA}}\x{{1F1E6}}-\x{{1F1FF}}]')) AS n_emojis,
        count(*) FILTER (basic LIKE 'fix:%' OR basic LIKE 'fix(%') AS n_fix, count(*) FILTER (basic LIKE 'feat:%' OR basic LIKE 'feat(%') AS n_feat FROM b""")
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    one = stats.corpus_overview(table(spark, d, "documents"), "text", "source", "created_at", unicode=False)
    return one.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_date", "max_date")})


@_query(r"""
    WITH e AS (SELECT DISTINCT repo, commit_hash, lower(regexp_extract(string_split(file, '/')[-1], '^.+(\.[^.]*)$', 1)) AS ext FROM mined_data WHERE repo <> '' AND commit_hash <> '' AND file IS NOT NULL)
    SELECT ext, count(*) AS n_commits FROM e WHERE ext <> '' GROUP BY 1""")
def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.extension_counts(fold.required(table(spark, d, "mined_data"), "repo", "commit_hash"), ["repo", "commit_hash"], "file")


@_query("""
    SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents WHERE created_at IS NOT NULL GROUP BY 1""")
def month_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.shares(table(spark, d, "documents"), F.date_format("created_at", "yyyy-MM"), "month")


_SHARE = "(SELECT year(created_at AT TIME ZONE 'UTC') AS y, count(*) / sum(count(*)) OVER () AS share FROM {0} GROUP BY 1)"


@_query(f"""
    WITH p AS (SELECT created_at FROM documents WHERE lang = 'en') SELECT CASE WHEN count(a.share) = count(b.share) THEN max(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) END AS max_drift,
        coalesce(count(a.share) = count(b.share) AND max(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) > 0.1, false) AS alert
    FROM {_SHARE.format("documents")} a FULL OUTER JOIN {_SHARE.format("p")} b USING (y)""")
def distribution_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return stats.drift(stats.shares(docs, F.year("created_at"), "y"), stats.shares(docs.where("lang = 'en'"), F.year("created_at"), "y"), "y")


@_query('SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM embeddings GROUP BY 1')
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_sizes(table(spark, d, "embeddings"), "label")


@_query("SELECT count(DISTINCT label) FILTER (label <> -1) AS n_clusters, count(*) FILTER (label = -1) AS n_noise, count(*) AS n_rows, count(*) FILTER (label = -1) / count(*) AS noise_share FROM embeddings")
def noise_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_summary(table(spark, d, "embeddings"), "label")


@_query("""
    WITH a AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT repo)::DOUBLE AS r, (count(*) FILTER (message IS NULL) / count(*))::DOUBLE AS m, (count(*) FILTER (coalesce(patch, '') = '') / count(*))::DOUBLE AS p FROM mined_data)
    SELECT 'records' AS "check", n AS value, n > 0 AS ok FROM a UNION ALL SELECT 'repositories', r, r >= 50 FROM a UNION ALL SELECT 'null_messages', m, m < 0.05 FROM a UNION ALL SELECT 'no_patch', p, p < 0.4 FROM a""")
def validations(spark: SparkSession, d: str) -> DataFrame:
    v, n = F.col("value"), F.count(F.lit(1))
    return stats.validate(table(spark, d, "mined_data"), {
        "records": (n, v > 0), "repositories": (F.count_distinct("repo"), v >= 50), "null_messages": (F.count_if(F.col("message").isNull()) / n, v < 0.05),
        "no_patch": (F.count_if(F.coalesce("patch", F.lit("")) == "") / n, v < 0.4),
    })


_PICKED = "(SELECT * FROM documents ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 169)"
_YEARS = "(SELECT year(created_at AT TIME ZONE 'UTC') AS y, count(*) / sum(count(*)) OVER () AS share FROM {0} x WHERE created_at IS NOT NULL GROUP BY 1)"


@_query(f"""
    WITH p AS (SELECT * FROM {_PICKED} x), m AS (SELECT count(*) AS n FROM p WHERE created_at IS NOT NULL GROUP BY strftime(created_at AT TIME ZONE 'UTC', '%Y-%m')),
    y AS (SELECT CASE WHEN count(a.share) = count(b.share) THEN max(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) END AS v FROM {_YEARS.format("documents")} a FULL OUTER JOIN {_YEARS.format("p")} b USING (y)),
    h AS (SELECT abs(median(n_chars) - (SELECT median(n_chars) FROM p)) / nullif(median(n_chars), 0) AS v FROM documents), u AS (SELECT count(*) FILTER (created_at IS NULL) / count(*) AS v FROM documents)
    SELECT 'sample_rows' AS "check", count(*)::DOUBLE AS value, count(*) BETWEEN 0.9 * 169 AND 1.1 * 169 AS ok FROM p UNION ALL SELECT 'thin_months', (count(*) FILTER (n < 5))::DOUBLE, count(*) FILTER (n < 5) = 0 FROM m
    UNION ALL SELECT 'yearly_drift', v, coalesce(v <= 0.1, false) FROM y UNION ALL SELECT 'median_drift', v, coalesce(v <= 0.2, false) FROM h UNION ALL SELECT 'undated', v, v < 0.05 FROM u""")
def corpus_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return stats.corpus_checks(docs, sampling.simple_sample(docs, "doc_id", 169), "created_at", F.col("n_chars"), 169, at_least=5)


@_query(f"""
    SELECT 'recount_repo' AS "check", count(*)::DOUBLE AS value, count(*) = 0 AS ok FROM (SELECT repo, count(*) AS n FROM mined_data GROUP BY 1) a
    FULL OUTER JOIN (SELECT repo AS r, count(*) AS c FROM {_KEYED} GROUP BY 1) b ON repo IS NOT DISTINCT FROM r WHERE n IS DISTINCT FROM c""")
def recount(spark: SparkSession, d: str) -> DataFrame:
    """Records of each repository against the sizes of its folded commits; those that folding leaves out differ."""
    sizes = _commits(spark, d).groupBy(F.col("repo_name").alias("repo")).agg(F.sum("n_files").alias("n"))
    return stats.recount(table(spark, d, "mined_data"), sizes, "repo", "n")


# ---- tokens

_WORDS = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda t: length(t) > 1 AND regexp_matches(t, '^[\p{{L}}\p{{N}}]+$') AND NOT regexp_matches(t, '^\p{{Nd}}+$') AND NOT list_contains([{_list(tokens.STOP_WORDS + tokens.TOOL_WORDS)}], t))"
_COUNTS = f"(SELECT token, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS token FROM documents) w GROUP BY 1)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    own = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda t: t != "")
    stops = tokens.STOP_WORDS + tokens.TOOL_WORDS
    return tokens.token_counts(docs, F.filter(own, lambda t: (F.length(t) > 1) & t.rlike(r"^[\p{L}\p{N}]+$") & ~t.rlike(r"^\p{Nd}+$") & ~t.isin(*stops)))


@_query(f"SELECT token, freq FROM {_COUNTS} c ORDER BY freq DESC, token LIMIT 60")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return tokens.top_tokens(_counts(spark, d), 60)


@_query(f"""
    SELECT sum(freq)::BIGINT AS top_freq, (SELECT sum(freq)::BIGINT FROM {_COUNTS} c) AS total_freq, sum(freq) / (SELECT sum(freq) FROM {_COUNTS} c) AS coverage
    FROM (SELECT freq FROM {_COUNTS} c ORDER BY freq DESC, token LIMIT 50) t""")
def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_coverage(_counts(spark, d), 50)


_BIGRAMS = rf"""(SELECT b AS bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (
    SELECT list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains([{_list(tokens.STOP_WORDS)}], t)) AS w FROM documents) x) y GROUP BY 1)"""


@_query(f"SELECT bigram, n FROM {_BIGRAMS} b ORDER BY n DESC, bigram LIMIT 20")
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return tokens.top_bigrams(table(spark, d, "documents"), F.col("text"))


@_query(f"""
    WITH top AS (SELECT token, freq FROM {_COUNTS} c ORDER BY freq DESC, token LIMIT 60)
    SELECT DISTINCT token FROM (SELECT token FROM top WHERE token IN ({_list(tokens.DOMAIN_TERMS)}) OR (freq > 0.01 * (SELECT count(*) FROM documents) AND length(token) > 2 AND NOT token IN ({_list(tokens.KEEP_TERMS)}))
        UNION ALL SELECT unnest([{_list(tokens.MERGE_TERMS)}]) UNION ALL SELECT bigram FROM (SELECT bigram FROM {_BIGRAMS} b ORDER BY n DESC, bigram LIMIT 20) g) t""")
def stop_word_suggestions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return tokens.stop_word_suggestions(tokens.top_tokens(_counts(spark, d), 60), docs.agg(F.count(F.lit(1)).alias("n")).scalar(), tokens.top_bigrams(docs, F.col("text")))


_CLEAN = r"lower(text)"
for _rx in (r"https?://\S+", r"(\s|^)(#|gh-|issue-|jira-)\d+\b", r"(?:signed-off|co-authored)-by:.*?<.*?>", r"\S+@\S+", r"[^a-z0-9\-\s]"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_rx}', ' ', 'g')"
_TERMS = rf"list_filter(string_split(coalesce(trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g')), ''), ' '), lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT starts_with(t, '-') AND NOT list_contains([{_list(tokens.STOP_WORDS)}], t))"
_RANKED = f"(SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({_TERMS}) AS term FROM documents) t GROUP BY 1, 2) c)"


@_query(f"SELECT lang, term, n, rank FROM {_RANKED} r WHERE rank <= 25")
def top_terms_per_language(spark: SparkSession, d: str) -> DataFrame:
    return tokens.top_terms_per_group(table(spark, d, "documents"), "lang", text.terms(F.col("text"), tokens.STOP_WORDS), 25)


@_query(rf"""
    WITH top AS (SELECT lang, term FROM {_RANKED} r WHERE rank <= 5), h AS (
        SELECT d.lang, t.term, d.doc_id, d.text FROM documents d JOIN top t ON d.lang = t.lang AND regexp_matches(d.text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])' || regexp_replace(t.term, '([-.+])', '\\\1', 'g')))
    SELECT lang, term, hits, example_no, CASE WHEN length(e) > 400 THEN e[1:400] || '...' ELSE e END AS example FROM (
        SELECT lang, term, count(*) OVER (PARTITION BY lang, term) AS hits, row_number() OVER (PARTITION BY lang, term ORDER BY doc_id) AS example_no,
            regexp_replace(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(' || regexp_replace(term, '([-.+])', '\\\1', 'g') || '[a-z]*)', '\1**\2**', 'g') AS e FROM h) x WHERE example_no <= 10""")
def term_contexts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    top = tokens.top_terms_per_group(docs, "lang", text.terms(F.col("text"), tokens.STOP_WORDS), 5)
    return tokens.term_contexts(docs, "lang", "doc_id", F.col("text"), F.col("text"), top)


# ---- samples

_DRAW = "md5('42|' || doc_id::VARCHAR), doc_id"
_DOCS = "(SELECT doc_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS stratum, n_chars FROM documents WHERE created_at IS NOT NULL)"


@_query(f"SELECT doc_id FROM documents ORDER BY {_DRAW} LIMIT 169")
def simple_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.simple_sample(table(spark, d, "documents"), "doc_id", 169).select("doc_id")


@_query(f"""
    SELECT doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_DRAW}) AS rn FROM {_DOCS} d) t
    WHERE rn <= (SELECT ceil(1000 / count(DISTINCT stratum)) FROM {_DOCS} d)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, "documents"), "doc_id", F.date_format("created_at", "yyyy-MM"), 1000).select("doc_id", "stratum")


@_query(f"""
    WITH c AS (SELECT *, CASE WHEN n_chars > (SELECT median(n_chars) FROM {_DOCS} d) THEN 'long' ELSE 'short' END AS category FROM {_DOCS} d),
    q AS (SELECT stratum, least(count(*), CASE WHEN count(*) < 5 THEN count(*) ELSE greatest(5, ceil(200 / (SELECT count(DISTINCT stratum) FROM c))) END) AS quota FROM c GROUP BY 1),
    r AS (SELECT c.*, quota, row_number() OVER (PARTITION BY c.stratum, category ORDER BY {_DRAW}) AS rn FROM c JOIN q USING (stratum)),
    f AS (SELECT doc_id, stratum, category FROM r WHERE rn <= ceil(quota / 2) ORDER BY stratum, CASE category WHEN 'short' THEN 0 ELSE 1 END, rn LIMIT 200),
    m AS (SELECT doc_id, stratum, category, row_number() OVER (ORDER BY {_DRAW}) AS k FROM c WHERE NOT doc_id IN (SELECT doc_id FROM f))
    SELECT * FROM f UNION ALL SELECT doc_id, stratum, category FROM m WHERE k <= 200 - (SELECT count(*) FROM f)""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(table(spark, d, "documents"), "doc_id", F.date_format("created_at", "yyyy-MM"), F.col("n_chars"), 200, at_least=5)


@_query(f"""
    WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW}) AS rn FROM (SELECT doc_id FROM documents ORDER BY {_DRAW} LIMIT 169) x), a AS (SELECT unnest(['a', 'b', 'c', 'd']) AS annotator)
    SELECT annotator, doc_id FROM s, a WHERE rn <= 17
    UNION ALL SELECT ['a', 'b', 'c', 'd'][ntile(4) OVER (ORDER BY rn)] AS annotator, doc_id FROM s WHERE rn > 17""")
def annotator_split(spark: SparkSession, d: str) -> DataFrame:
    picked = sampling.simple_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 169)
    return sampling.annotator_split(picked, "doc_id", ["a", "b", "c", "d"], 17).select("annotator", "doc_id")


# ---- diffs and configuration

_LINES = r"""
    WITH p AS (SELECT DISTINCT patch FROM mined_data WHERE length(patch) > 0),
    l AS (SELECT patch, unnest(string_split(patch, chr(10))) AS line, generate_subscripts(string_split(patch, chr(10)), 1) AS line_no FROM p),
    h AS (SELECT *, sum(CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END) OVER (PARTITION BY patch ORDER BY line_no) AS hunk FROM l),
    k AS (SELECT *, CASE WHEN hunk = 0 OR line LIKE '@@%' THEN 'head' WHEN line LIKE '+%' THEN 'added' WHEN line LIKE '-%' THEN 'removed' WHEN starts_with(line, chr(92)) THEN 'head' ELSE 'context' END AS kind,
        try_cast(nullif(regexp_extract(first_value(line) OVER (PARTITION BY patch, hunk ORDER BY line_no), '^@@ -(\d+)', 1), '') AS INT) AS o0,
        try_cast(nullif(regexp_extract(first_value(line) OVER (PARTITION BY patch, hunk ORDER BY line_no), '^@@ -\S+ \+(\d+)', 1), '') AS INT) AS n0 FROM h)
    SELECT md5(patch) AS patch_id, line_no, CASE WHEN kind IN ('added', 'removed') THEN kind ELSE 'other' END AS change, CASE WHEN kind = 'head' THEN line ELSE line[2:] END AS content,
        (CASE WHEN kind IN ('removed', 'context') THEN coalesce(o0, 1) - 1 + sum(CASE WHEN kind IN ('removed', 'context') THEN 1 ELSE 0 END) OVER (PARTITION BY patch, hunk ORDER BY line_no) END)::INT AS old_lineno,
        (CASE WHEN kind IN ('added', 'context') THEN coalesce(n0, 1) - 1 + sum(CASE WHEN kind IN ('added', 'context') THEN 1 ELSE 0 END) OVER (PARTITION BY patch, hunk ORDER BY line_no) END)::INT AS new_lineno FROM k"""


@_query(_LINES)
def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    patches = table(spark, d, "mined_data").where("length(patch) > 0").select("patch").distinct().withColumn("patch_id", F.md5("patch"))
    return diff.diff_lines(patches, keep=["patch_id"])


@_query(rf"""
    WITH e AS (SELECT nullif(regexp_extract(content, '^\s*(?:resource|data)\s+"([^"]+)"\s+"[^"]+"', 1), '') AS resource_type, nullif(regexp_extract(content, '^\s*([A-Za-z_][\w-]*)\s*=(?:[^=]|$)', 1), '') AS attr_name, change FROM ({_LINES}) x)
    SELECT resource_type, attr_name, change, count(*) AS n FROM e WHERE resource_type IS NOT NULL OR attr_name IS NOT NULL GROUP BY 1, 2, 3""")
def diff_enrich(spark: SparkSession, d: str) -> DataFrame:
    rows = diff.enrich(diff_lines(spark, d)).where("resource_type IS NOT NULL OR attr_name IS NOT NULL")
    return rows.groupBy("resource_type", "attr_name", "change").agg(F.count(F.lit(1)).alias("n"))


@_query(rf"""
    WITH r AS (SELECT md5(patch) AS patch_id, repo, commit_hash, file FROM mined_data WHERE length(patch) > 0), l AS ({_LINES}),
    n AS (SELECT patch_id, count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS d, count(*) AS n FROM l GROUP BY 1)
    SELECT count(DISTINCT repo) AS n_repos, count(DISTINCT commit_hash) AS n_commits, count(DISTINCT file) AS n_files,
        (SELECT count(DISTINCT nullif(regexp_extract(content, '^\s*(?:resource|data)\s+"([^"]+)"\s+"[^"]+"', 1), '')) FROM l) AS n_resource_types,
        sum(a)::BIGINT AS n_added, sum(d)::BIGINT AS n_removed, sum(n)::BIGINT AS n_lines FROM r JOIN n USING (patch_id)""")
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = diff.enrich(diff.diff_lines(table(spark, d, "mined_data"), keep=["repo", "commit_hash", "file"]))
    return diff.line_stats(rows, "repo", "commit_hash", "file")


@_query(r"""
    SELECT CASE WHEN coalesce(length(patch), 0) = 0 THEN 'empty' WHEN regexp_matches(patch, '(?m)^@@ ') THEN 'diff' ELSE 'content' END AS kind, count(*) AS n FROM mined_data GROUP BY 1""")
def patch_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mined_data").groupBy(diff.patch_kind(F.col("patch")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_FILE = ["repo", "commit_hash", "file"]
_TF = "(SELECT DISTINCT repo, commit_hash, file, patch FROM mined_data WHERE file LIKE '%.tf' AND length(patch) > 0)"


def _tf_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mined_data").where("file LIKE '%.tf' AND length(patch) > 0").select(*_FILE, "patch").distinct()


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    return hcl.attributes(_tf_files(spark, d), _FILE, "patch", "new")


@_query()
def hcl_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).select(*_FILE, "path", "value")


@_query(f"SELECT count(*) AS n_files, count(*) AS n_known, 0 AS n_foreign, 0 AS n_lost FROM {_TF} t")
def hcl_parse_check(spark: SparkSession, d: str) -> DataFrame:
    """Files, files with a known status, attributes whose name their patch does not have, and files said to be whole that give nothing but hold an assignment."""
    files = _tf_files(spark, d)
    status = hcl.parse_status(files.withColumn("p", F.col("patch")), [*_FILE, "p"], "patch", "new")
    one = status.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status").isin("empty", "whole", "partial", "failed")).alias("n_known"),
        F.count_if((F.col("status") == "whole") & (F.col("n_attributes") == 0) & F.col("p").rlike(r'(?m)^[ +][ ]*[a-z_]+ *= *"[^"\n]*"$')).alias("n_lost"),
    )
    attrs = hcl.attributes(files.withColumn("p", F.col("patch")), ["p"], "patch", "new")
    name = F.element_at(F.split("path", r"\."), -1)
    foreign = attrs.agg(F.count_if(~F.contains(F.col("p"), name)).alias("n_foreign"))
    return one.join(foreign, F.lit(True)).select("n_files", "n_known", F.col("n_foreign").cast("int").alias("n_foreign"), F.col("n_lost").cast("int").alias("n_lost"))


@_query()
def hcl_parse_status(spark: SparkSession, d: str) -> DataFrame:
    return hcl.parse_status(_tf_files(spark, d), _FILE, "patch", "new").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("skipped").alias("skipped"), F.sum("n_attributes").alias("n_attributes"))


@_query()
def hcl_json(spark: SparkSession, d: str) -> DataFrame:
    return hcl.to_json(_tf_files(spark, d), _FILE, "patch", "new")


@_query()
def hcl_resources(spark: SparkSession, d: str) -> DataFrame:
    return hcl.resources(_attributes(spark, d), ["repo"]).withColumn("for_each", F.to_json("for_each"))


@_query()
def hcl_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return hcl.dependencies(_attributes(spark, d), ["repo"])


@_query()
def hcl_attribute_usage(spark: SparkSession, d: str) -> DataFrame:
    return hcl.attribute_usage(_attributes(spark, d))


@_query()
def hcl_dynamic_blocks(spark: SparkSession, d: str) -> DataFrame:
    return hcl.dynamic_blocks(_attributes(spark, d), ["repo"])


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = _tf_files(spark, d).where(F.col("patch").startswith("@@"))
    return hcl.attributes(files, _FILE, "patch", "old"), hcl.attributes(files, _FILE, "patch", "new")


@_query()
def hcl_changes(spark: SparkSession, d: str) -> DataFrame:
    """Attribute changes of each changed file: the diff's old side against its new side."""
    old, new = (a.groupBy(*_FILE, "path").agg(F.min("value").alias("value")) for a in _sides(spark, d))
    return hcl.attribute_changes(old, new, _FILE)


@_query()
def hcl_dependency_changes(spark: SparkSession, d: str) -> DataFrame:
    return hcl.dependency_changes(*_sides(spark, d), _FILE)


# ---- vectors, clusters, reports


@_query("""
    SELECT vec_id, round(d, 5) AS core_distance FROM (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS rn FROM embeddings a, embeddings b) t WHERE rn = 10""")
def core_distance(spark: SparkSession, d: str) -> DataFrame:
    return density.core_distance_rows(table(spark, d, "embeddings"), "vec_id", "embedding", 10).select("vec_id", F.round("core_distance", 5).alias("core_distance"))


@_query()
def spanning_edges(spark: SparkSession, d: str) -> DataFrame:
    return density.spanning_edges(table(spark, d, "embeddings"), "vec_id", "embedding")


@_query("""
    WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b),
    c AS (SELECT vec_id, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rn FROM p) t WHERE rn = 10)
    SELECT p.vec_id, round(min(greatest(d, a.core, b.core)), 4) AS nearest FROM p JOIN c a ON a.vec_id = p.vec_id JOIN c b ON b.vec_id = p.other WHERE p.vec_id <> p.other GROUP BY 1""")
def spanning_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's lightest edge in the spanning tree, which is the lightest of all its edges."""
    edges = spanning_edges(spark, d)
    ends = edges.select(F.col("src").alias("vec_id"), "weight").union(edges.select("dst", "weight"))
    return ends.groupBy("vec_id").agg(F.round(F.min("weight"), 4).alias("nearest"))


@_query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, 0::BIGINT AS n_small_clusters, 0::BIGINT AS n_odd_probabilities FROM embeddings")
def density_check(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows, clusters below the smallest size, probabilities outside of 0 to 1 or of noise."""
    vectors = table(spark, d, "embeddings")
    size, samples = density.cluster_parameters(vectors.count())
    rows = density.cluster_by_density(vectors, "vec_id", "embedding", size, samples)
    small = rows.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") < size).alias("n_small_clusters"))
    odd = ~F.col("probability").between(0, 1) | (F.col("label") == -1) & (F.col("probability") != 0)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.count_if(odd).alias("n_odd_probabilities")).join(small, F.lit(True))


@_query("SELECT count(*) AS n_docs, count(*) FILTER (regexp_matches(coalesce(text, ''), '[^\\s\\x0b\\x{85}\\p{Z}]')) AS n_unit FROM documents")
def tfidf_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those whose vector has length 1: all but blank ones."""
    rows = embed.tfidf(table(spark, d, "documents"), F.col("text"), 256)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.abs(norm - 1) < 1e-6).alias("n_unit"))


@_query()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    size, samples = density.cluster_parameters(vectors.count())
    return density.cluster_by_density(vectors, "vec_id", "embedding", size, samples)


@_query()
def pca_reduce(spark: SparkSession, d: str) -> DataFrame:
    return embed.reduce_pca(table(spark, d, "embeddings"), "embedding").select("vec_id", "reduced")


@_query()
def tfidf_embed(spark: SparkSession, d: str) -> DataFrame:
    return embed.tfidf(table(spark, d, "documents"), F.col("text"), 256).select("doc_id", "embedding")


@_query()
def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL").withColumn("label", F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(9)).cast("int") - 1)
    return report.cluster_report(docs, "label", "doc_id", "text", "text", tokens.STOP_WORDS, lemmatise=True)


# ---- streams


@_query("""
    SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(table(spark, d, "events"), "ts", "event_type", F.col("value"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@_query("SELECT repo, count(*) AS n FROM (SELECT DISTINCT repo, commit_hash, file FROM mined_data) t GROUP BY 1")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The mined table taken in as a stream, each key once."""
    from ..sources.sinks import append_mined

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ingest-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(table(spark, d, "mined_data").schema).option("recursiveFileLookup", True).parquet(f"{d}/mined_data.parquet*")
    q = rows.writeStream.foreachBatch(lambda df, _: append_mined(df, f"{base}/rows")).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT count(*) AS n, count(ts) AS dated, min(ts AT TIME ZONE 'UTC') AS first, max(ts AT TIME ZONE 'UTC') AS last FROM (SELECT coalesce(try_strptime(regexp_replace(trim(date), 'Z$', '+00:00'), '%Y-%m-%dT%H:%M:%S%z'), try_strptime(trim(date), '%Y-%m-%d %H:%M:%S %z'), try_strptime(trim(date), '%a %b %d %H:%M:%S %Y %z')) AS ts FROM mined_data) t")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    ts = to_instant(F.col("date"))
    return table(spark, d, "mined_data").agg(F.count(F.lit(1)).alias("n"), F.count(ts).alias("dated"), F.min(ts).cast("timestamp_ntz").alias("first"), F.max(ts).cast("timestamp_ntz").alias("last"))
