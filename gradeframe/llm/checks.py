"""The registered queries of this subpackage over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import decontaminate, filter_audit, line_dedup, manifest, minhash, neighbours, packing, pii, quality_model, quality_rules, sharding, suffix_dedup, url_filter


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, into="x", carry=["doc_id"])
    base = pii.listed({k: F.col(f"x.{k}") for k in pii.KINDS})
    return found.select(
        "doc_id", *[F.size(f"x.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        pii.listed({k: F.col(f"x.{k}_all") for k in pii.KINDS}).alias("spans"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).drop("url")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = quality_model.held_out("doc_id")
    scored = quality_model.score_documents(docs, table(spark, folder, "labels"), ~held, carry=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, table(spark, folder, "benchmark"), into="x", carry=["doc_id"])
    return found.select(
        "doc_id", "x.n_words", "x.n_hit", F.size("x.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("x.item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("x.n_hit") > 0).alias("contaminated"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs, into="lines")
    return kept.select(
        "doc_id", "lines.n_lines", "lines.n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, into="x", carry=["doc_id"])
    return found.select("doc_id", "x.n_bytes", "x.n_removed", F.size("x.spans").cast("long").alias("n_spans"),
                        F.sha2("x.kept", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents").select("doc_id", "text"), carry=["doc_id"])


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    q = quality_rules.judge_documents(docs, into="q", carry=["doc_id"])
    return q.select("doc_id", *[f"q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")])


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, folder, "labels"))


def op13_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, lambda vec_id: vec_id % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_url_filter, op3_quality_classifier, op4_decontamination, op5_line_dedup, op6_suffix_dedup, op7_sharding, op8_packing, op9_minhash, op10_quality_rules,
        op11_merkle_manifest, op12_filter_audit, op13_neighbours)
}
SQL: dict[str, str] = {
    "op2_url_filter": url_filter.filter_sql(),
    "op4_decontamination": decontaminate.contamination_sql(),
    "op5_line_dedup": line_dedup.dedup_sql(),
    "op6_suffix_dedup": suffix_dedup.repeats_sql(),
    "op7_sharding": sharding.shards_sql(),
    "op9_minhash": minhash.groups_sql(),
    "op11_merkle_manifest": manifest.manifest_sql(),
    "op12_filter_audit": filter_audit.audit_sql(),
}
