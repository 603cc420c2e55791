"""Queries pN_... of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import defects, leakage, mojibake, near_duplicates, packing, prose, ranking, tokens
from .base import materialize, table
from .sql import SQL

PAIRS = near_duplicates.NearDupConfig(shingle=3, threshold=0.5)


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return prose.languages(table(spark, d, "processed_shards"), table(spark, d, "lang_samples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(a) line_no 0: records whose stored label is missing or isn't their language; (b) lines of mixed prose records."""
    got = materialize(_languages(spark, d), "languages")
    stored = F.substring_index(F.lower(F.regexp_replace("label", r"^\s+|\s+$", "")), "-", 1)
    wrong = got.where(~F.coalesce(stored == F.col("lang"), F.lit(False))).select("id", F.lit(0).alias("line_no"), "lang")
    labels = F.array_distinct(F.transform(F.filter("lines", lambda x: x.words >= 4), lambda x: x.lang))
    mixed = got.where(F.col("is_prose") & (F.size(labels) > 1))
    lines = mixed.select("id", F.explode("lines").alias("x")).select("id", "x.line_no", "x.lang")
    return wrong.union(lines)


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its language and confidence, and every line of it."""
    got = _languages(spark, d)
    return got.select("id", "lang", F.col("confidence").cast("double"), F.col("lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking(table(spark, d, "ratings"), table(spark, d, "model_registry")).select("model", "rank_no")


def p2_strengths(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking(table(spark, d, "ratings"), table(spark, d, "model_registry")).withColumn("strength", F.round("strength", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_statistics(spark, d).where("not is_prose").select("id")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.text_statistics(table(spark, d, "processed_shards"), table(spark, d, "lang_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each defect of a pair."""
    return p4_pairs(spark, d).select("sft_id", F.explode("defects").alias("defect"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return defects.pair_defects(table(spark, d, "sft_sample"), table(spark, d, "lang_samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "processed_shards"), "id", "text", "written_at", PAIRS)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups at five words and a similarity of 0.8: one row per record."""
    return near_duplicates.near_duplicate_groups(table(spark, d, "processed_shards"), "id", "text", "written_at")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives at five words and 0.8; ``p5_groups`` has the members of each class."""
    links = near_duplicates.near_duplicate_classes(table(spark, d, "processed_shards"), "id", "text", "written_at")[1]
    return links.withColumn("similarity", F.round("similarity", 6))


def p6_record_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.record_tokens(table(spark, d, "processed_shards"), table(spark, d, "tokenizer_pieces"))


def p6_slice_totals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.slice_totals(p6_record_tokens(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens.document_tokens(table(spark, d, "documents"), table(spark, d, "tokenizer_pieces"), "doc_id", "text", ["source"])
    items = docs.groupBy(F.col("doc_id").alias("item_id")).agg(F.max("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
    packed = packing.pack(materialize(items, "items"))
    return packed.withColumnRenamed("item_id", "doc_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = leakage.evaluation_items(table(spark, d, "tamil_cloze"), table(spark, d, "chat_eval_prompts"))
    return leakage.contained_items(table(spark, d, "documents"), "doc_id", "text", items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_containment(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumn("containment", F.round(F.col("windows") / F.col("item_windows"), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_documents(table(spark, d, "documents"), order_col="ingested_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p1_found, p1_languages, p2_found, p2_strengths, p3_found, p3_statistics, p4_found, p4_pairs, p5_found, p5_groups, p5_links,
        p6_record_tokens, p6_slice_totals, p7_containers, p8_found, p8_containment, p9_found, p9_restored,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return SQL
