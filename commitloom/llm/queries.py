"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import token_count
from ..sources.tables import table
from . import clusters, consensus, handwritten, mixing, packing, secrets, stratify, truncation

CATEGORIES = ["year_month", "msg_len_category"]


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(table(spark, d, "mined_data"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_files(spark, d).where(F.col("reason").isNotNull()).select("repo", "commit_hash", "file")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(table(spark, d, "mined_data")).select("repo", "commit_hash", "file", "line_no").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_secrets(table(spark, d, "mined_data"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similar_pairs(clusters.cluster_messages(table(spark, d, "mined_data")))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    mined = table(spark, d, "mined_data")
    return clusters.describe_clusters(clusters.cluster_messages(mined), mined)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    refs = consensus.commit_refs({a: table(spark, d, f"sample_{a}") for a in ("heleno", "isadora", "vania", "joao")})
    return consensus.resolve_commits(refs, table(spark, d, "mined_data"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_labels(spark, d))[0].where("n_labels >= 2 and consensus = 'yes'").select(F.col("item").alias("commit_hash"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_labels(spark, d))[0]


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_labels(spark, d))[1]


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stratify.sample_to_targets(stratify.eligible_commits(table(spark, d, "mined_data")), "commit_hash", CATEGORIES, table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where("deficit > 0").select("target_id")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].select("target_id", *CATEGORIES, "wanted", "available", "drawn", "deficit")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pack(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_pack(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "documents")).where("truncated").select("doc_id").distinct()


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(truncation.find_truncated(table(spark, d, "documents")))


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Documents by what speaks for a cut, and how many of them trie and length find alone."""
    docs = table(spark, d, "documents")
    found = truncation.find_truncated(docs).where("truncated")
    alone = F.col("evidence").rlike(r"\b(?:word|length)\b")
    return found.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(alone).alias("n_by_trie_or_length"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return p1_files(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- what every result has to fulfil, next to SQL over the tables


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Keys, and keys below vendored directories that are left as hand-written in repositories without attribute files."""
    low = F.lower(handwritten.normal_path(F.col("file")))
    return p1_files(spark, d).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.coalesce(low.rlike("(?:^|/)(?:vendor|node_modules)/"), F.lit(False)) & F.col("reason").isNull()).alias("n_missed"))


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows and lines after masking, and rows whose text changed although nothing was masked."""
    mined = table(spark, d, "mined_data").withColumn("original", F.col("patch"))
    lines = F.regexp_count("patch", F.lit("\n"))
    return secrets.redact_secrets(mined).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(lines).cast("bigint").alias("n_line_ends"), F.count_if((F.col("secrets_masked") == 0) & ~F.col("patch").eqNullSafe(F.col("original"))).alias("n_changed"),
        F.count_if((F.col("secrets_masked") > 0) & F.col("patch").eqNullSafe(F.col("original"))).alias("n_unmasked"),
    )


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """Commits in clusters, commits in several, clusters whose size is not their commits' number, clusters without one medoid."""
    rows = clusters.cluster_messages(table(spark, d, "mined_data"))
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("size").alias("least"), F.count_distinct(F.when(F.col("medoid"), F.col("form"))).alias("medoids"))
    one = per.agg(F.sum("n").alias("n_commits"), F.count_if((F.col("n") != F.col("size")) | (F.col("size") != F.col("least"))).alias("n_wrong_sizes"), F.count_if(F.col("medoids") != 1).alias("n_wrong_medoids"))
    twice = rows.groupBy("commit_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_repeated"))
    return one.join(twice, F.lit(True))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn for each target, and rows drawn twice."""
    drawn = p5_sample(spark, d).groupBy("target_id", "commit_hash").agg(F.count(F.lit(1)).alias("n"))
    return drawn.groupBy("target_id").agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens placed, containers above capacity, texts split needlessly, pieces that do not follow each other."""
    packed = p7_pack(spark, d)
    boxes = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 1024).alias("n_overfull"))
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    one = texts.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 1024)).alias("n_split_needlessly"),
        F.count_if((F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / 1024))) | (F.col("end") != F.col("n"))).alias("n_broken"),
    )
    return one.join(boxes, F.lit(True))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target: documents repeated too often, places taken twice, and whether the tokens drawn are the quota but for half of the source's largest document."""
    mix, report = _mixed(spark, d)
    copies = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies")).groupBy("source").agg(F.max("copies").alias("most"))
    copies = copies.join(table(spark, d, "documents").groupBy("source").agg(F.max(token_count(F.col("text"))).alias("largest")), "source", "full_outer")
    taken = mix.groupBy("shard", "slot").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_shared_places"))
    rows = report.join(copies, "source", "left").join(taken, F.lit(True))
    near = F.abs(F.col("drawn") - F.col("quota")) <= F.coalesce("largest", F.lit(0)) / 2 + 1
    return rows.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), "n_shared_places", near.alias("quota_met"), "short")


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and documents without text that are called cut."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    found = truncation.find_truncated(docs).join(docs.where("coalesce(trim(text), '') = ''").select("doc_id", F.lit(True).alias("blank")), "doc_id", "left")
    return found.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.coalesce("blank", F.lit(False)) & F.col("truncated")).alias("n_blank_cut"))


QUERIES = {
    "p7_found": p7_found, "p7_pack": p7_pack, "p7_report": p7_report,
    "p6_found": p6_found, "p6_items": p6_items, "p6_annotators": p6_annotators,
    "p4_found": p4_found, "p4_clusters": p4_clusters,
    "p9_found": p9_found, "p9_by_source": p9_by_source,
    "p3_found": p3_found, "p3_redacted": p3_redacted,
    "p1_found": p1_found, "p1_files": p1_files,
    "p5_found": p5_found, "p5_sample": p5_sample, "p5_report": p5_report,
    "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report,
    "p9_evidence": p9_evidence, "p1_reasons": p1_reasons,
    "p1_check": p1_check, "p3_check": p3_check, "p4_check": p4_check, "p5_check": p5_check, "p7_check": p7_check, "p8_check": p8_check, "p9_check": p9_check,
}

_ELIGIBLE = """
    parsed AS (
        SELECT commit_hash, length(message) AS len, coalesce(
            try_strptime(regexp_replace(trim(date), 'Z$', '+00:00'), '%Y-%m-%dT%H:%M:%S%z'), try_strptime(trim(date), '%Y-%m-%d %H:%M:%S %z'),
            try_strptime(trim(date), '%a %b %d %H:%M:%S %Y %z')) AS ts
        FROM mined_data WHERE commit_hash <> '' AND message IS NOT NULL),
    eligible AS (
        SELECT commit_hash, strftime(min(ts) AT TIME ZONE 'UTC', '%Y-%m') AS year_month,
            CASE WHEN min(len) > 100 THEN 'long' ELSE 'short' END AS msg_len_category
        FROM parsed WHERE ts IS NOT NULL GROUP BY 1),
    wanted AS (
        SELECT t.*, greatest(min_rows, ceil(target_share * floor(0.2 * (SELECT count(*) FROM eligible))))::BIGINT AS wanted,
            (SELECT count(*) FROM eligible e WHERE e.year_month = t.year_month AND e.msg_len_category = t.msg_len_category) AS available
        FROM sample_targets t)"""
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]+'))"

_SHORT = f"""WITH t AS (SELECT source, {_TOKENS} AS n FROM documents)
        SELECT m.source, coalesce(s.n, 0) * m.max_repeats < m.target_weight * (SELECT sum(n) FROM t) * 0.5 AS short FROM mix_targets m LEFT JOIN (SELECT source, sum(n) AS n FROM t GROUP BY 1) s USING (source)"""

SQL = {
    "p1_check": "SELECT count(*) AS n_keys, 0::BIGINT AS n_missed FROM (SELECT DISTINCT repo, commit_hash, file FROM mined_data) t",
    "p3_check": "SELECT count(*) AS n_rows, sum(length(patch) - length(replace(patch, chr(10), '')))::BIGINT AS n_line_ends, 0::BIGINT AS n_changed, 0::BIGINT AS n_unmasked FROM mined_data",
    "p4_check": "SELECT count(DISTINCT commit_hash) AS n_commits, 0::BIGINT AS n_wrong_sizes, 0::BIGINT AS n_wrong_medoids, 0::BIGINT AS n_repeated FROM mined_data WHERE commit_hash <> '' AND message <> ''",
    "p5_check": f"WITH {_ELIGIBLE} SELECT target_id, least(wanted, available) AS drawn, 0::BIGINT AS n_repeated FROM wanted WHERE least(wanted, available) > 0",
    "p7_check": f"SELECT count(*) AS n_docs, sum({_TOKENS})::BIGINT AS n_tokens, 0::BIGINT AS n_split_needlessly, 0::BIGINT AS n_broken, 0::BIGINT AS n_overfull FROM documents",
    "p8_check": f"SELECT source, true AS repeats_kept, 0::BIGINT AS n_shared_places, true AS quota_met, short FROM ({_SHORT}) x",
    "p9_check": "SELECT count(*) AS n_docs, 0::BIGINT AS n_blank_cut FROM documents",
    "p5_found": f"WITH {_ELIGIBLE} SELECT target_id FROM wanted WHERE available < wanted",
    "p5_report": f"""WITH {_ELIGIBLE} SELECT target_id, year_month, msg_len_category, wanted, available, least(wanted, available) AS drawn,
        wanted - least(wanted, available) AS deficit FROM wanted""",
    "p7_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_TOKENS} > 1024",
    "p8_found": f"""WITH t AS (SELECT source, {_TOKENS} AS n FROM documents)
        SELECT m.source FROM mix_targets m LEFT JOIN (SELECT source, sum(n) AS n FROM t GROUP BY 1) s USING (source)
        WHERE coalesce(s.n, 0) * m.max_repeats < m.target_weight * (SELECT sum(n) FROM t) * 0.5""",
}
