"""The curation pipeline: normalise, filter lines, label, route, judge, deduplicate, split, augment, write."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import langid, normalize
from ..operators import augment, dedup, lines, quality, split
from ..operators.tables import materialize
from ..sources import writers


@dataclass(frozen=True)
class SourceRules:
    """What a source says of its documents."""

    lang_hint: str | None = None
    category: str = "other"
    allowed_langs: tuple[str, ...] | None = None  # default: the hint, else ta
    quality_profile: str | None = None
    routing: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineConfig:
    normalizer: normalize.NormalizerConfig = normalize.NormalizerConfig(urls="remove", emails="mask", phones="mask")
    line_filter: lines.LineFilterConfig = lines.LineFilterConfig()
    langid: langid.LangIdConfig = langid.LangIdConfig()
    quality: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    dedup: dedup.DedupConfig = dedup.DedupConfig()
    augment: augment.AugmentConfig = augment.AugmentConfig()
    augment_langs: tuple[str, ...] = ("ta",)
    default_routing: Mapping[str, str] = field(default_factory=dict)
    sources: Mapping[str, SourceRules] = field(default_factory=dict)
    eval_fraction: float = 0.01
    max_eval_docs: int = 1000


def clean(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Text normalised and line-filtered; ``reject_reason`` for what is then empty."""
    text = normalize.normalize("text", cfg.normalizer)
    out = df.withColumn("text", text).withColumn("text", lines.filter_lines("text", cfg.line_filter))
    return out.withColumn("reject_reason", F.when(F.col("text") == "", "empty_after_cleaning"))


def _per_source(cfg: PipelineConfig, value) -> Column:
    """A column that depends on the source: one WHEN branch per configured source, the default for all others."""
    out = value(SourceRules())
    for name, rules in cfg.sources.items():
        out = F.when(F.col("source") == name, value(rules)).otherwise(out)
    return out


def label(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    out = df.withColumn("_l", langid.detect("text", cfg.langid)).select("*", "_l.*").drop("_l")
    allowed = _per_source(cfg, lambda r: F.array(*[F.lit(x) for x in (r.allowed_langs or (r.lang_hint or "ta",))]))
    bad = ~F.array_contains(allowed, F.col("lang"))
    out = out.withColumn("reject_reason", F.coalesce("reject_reason", F.when(bad, F.concat(F.lit("lang_"), "lang"))))
    category = _per_source(cfg, lambda r: langid.route("lang", r.lang_hint, r.category, r.routing, cfg.default_routing))
    profile = _per_source(cfg, lambda r: F.lit(r.quality_profile) if r.quality_profile else F.col("lang"))
    return out.withColumn("category", category).withColumn("profile", profile)


def judge(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Quality thresholds of each profile, on documents that are still in; one pass, whatever the number of profiles."""
    marked = df.withColumnRenamed("reject_reason", "_earlier")
    out = quality.profiled_filter(marked, "text", F.col("profile"), quality.resolve_profiles(cfg.quality), F.col("_earlier").isNull())
    return out.withColumn("reject_reason", F.coalesce("_earlier", "reject_reason")).drop("_earlier")


def curate(df: DataFrame, cfg: PipelineConfig, order_col: str = "seq") -> DataFrame:
    """df: (text, source, source_id, order) -> every document with its outcome, in one wide table.

    The cleaned texts are written once.  One pass over them gives a narrow table of verdicts, keys and signatures, on
    which deduplication works, and which the texts join at the end.  Rejected texts have neither key nor signature.
    """
    labelled = materialize(label(clean(df, cfg), cfg), "labelled")  # what follows would evaluate the chain again
    judged = judge(labelled, cfg)
    live = F.when(F.col("reject_reason").isNull(), F.col("text"))
    narrow = materialize(judged.select(F.col(order_col).alias("seq"), "reject_reason", *dedup.key_columns(live, cfg.dedup)), "judged")
    dups = dedup.verdicts_of(narrow.where("reject_reason is null").drop("reject_reason"), cfg.dedup)
    verdicts = narrow.where("reject_reason is not null").select("seq", "reject_reason", F.lit(None).cast("string").alias("dup"))
    verdicts = verdicts.union(dups.select("seq", F.lit(None).cast("string"), "dup")).withColumnRenamed("seq", order_col)
    outcome = F.coalesce("reject_reason", F.concat(F.lit("dup_"), "dup"), F.lit("kept"))
    return labelled.drop("reject_reason").join(verdicts, order_col, "left").withColumn("outcome", outcome).withColumn("id", dedup.record_id("text"))


def corpus(curated: DataFrame, cfg: PipelineConfig, order_col: str = "seq") -> DataFrame:
    """Kept records with their split, and the synthetic ones."""
    kept = split.capped_split(curated.where("outcome = 'kept'"), "id", "category", order_col, cfg.eval_fraction, cfg.max_eval_docs)
    fields = ["id", "text", "source", "source_id", "category", "lang", "tamil_ratio", "latin_ratio", "tanglish_score", "english_score", "split_name"]
    records = kept.select(*fields)
    if not cfg.augment.enabled:
        return records
    return records.unionByName(augment.augment(kept, cfg.augment, cfg.augment_langs), allowMissingColumns=True)


def outcome_counts(curated: DataFrame) -> DataFrame:
    """(source, outcome, n), with 'seen' for all and 'lang_kept_<label>' for kept ones."""
    marks = F.array(F.lit("seen"), F.col("outcome"), F.when(F.col("outcome") == "kept", F.concat(F.lit("lang_kept_"), "lang")))
    each = curated.select("source", F.explode(marks).alias("outcome")).where("outcome is not null")
    return each.groupBy("source", "outcome").agg(F.count("*").alias("n"))


def category_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("category", "split_name").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def run(df: DataFrame, cfg: PipelineConfig, out: str, overwrite: bool = False, order_col: str = "seq") -> dict[str, Any]:
    """Curate, write the corpus and its stats."""
    writers.prepare_output(out, overwrite)
    curated = materialize(curate(df, cfg, order_col), "curated")
    records = materialize(corpus(curated, cfg, order_col), "corpus")
    writers.write_corpus(records, f"{out}/corpus")
    return writers.run_stats(outcome_counts(curated), category_sizes(records), out)
