"""Synthetic records from training documents: romanised and spoken copies."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import as_col, last_newline
from ..functions.tanglish import colloquialize, transliterate
from .dedup import record_id
from .split import stable_fraction


@dataclass(frozen=True)
class AugmentConfig:
    enabled: bool = False
    tanglish_fraction: float = 0.0
    spoken_fraction: float = 0.0
    colloquialize_before_translit: bool = True
    variant_prob: float = 0.15
    sentence_mix_prob: float = 0.0
    max_chars: int = 4000
    tanglish_category: str = "tanglish_synthetic"
    spoken_category: str = "ta_spoken_synthetic"
    seed: int = 7

    @classmethod
    def from_dict(cls, d: Mapping[str, Any] | None) -> "AugmentConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in dict(d or {}).items() if k in known})


def truncate(c: str | Column, max_chars: int) -> Column:
    """At most max_chars: cut at the last line feed before the limit if that is past its half, else at the limit."""
    t = as_col(c)
    head = F.substring(t, 1, max_chars)
    at = last_newline(head) - 1
    return F.when(F.length(t) <= max_chars, t).when(at > max_chars // 2, F.substring(head, F.lit(1), at)).otherwise(head)


def augment(df: DataFrame, cfg: AugmentConfig, source_langs: Sequence[str] = ("ta",), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Synthetic rows (id, text, category, synthetic, parent_id, split_name) of training rows in the given languages.

    Which rows spawn a copy is drawn by a hash of the id, so it depends neither on order nor on partitions.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "id string, text string, category string, synthetic boolean, parent_id string, split_name string")
    if not cfg.enabled:
        return empty
    base = df.where((F.col("split_name") == "train") & F.col("lang").isin(*source_langs))
    parent = F.col(id_col).cast("string")
    cut = truncate(text_col, cfg.max_chars)
    made = []
    if cfg.tanglish_fraction:
        chosen = base.where(stable_fraction(id_col, f"tanglish:{cfg.seed}:") < cfg.tanglish_fraction)
        source = colloquialize(cut) if cfg.colloquialize_before_translit else cut
        text = transliterate(source, parent, cfg.variant_prob, cfg.sentence_mix_prob, cfg.seed)
        made.append(chosen.select(text.alias("text"), F.lit(cfg.tanglish_category).alias("category"), parent.alias("parent_id")))
    if cfg.spoken_fraction:
        chosen = base.where(stable_fraction(id_col, f"spoken:{cfg.seed}:") < cfg.spoken_fraction)
        rows = chosen.select(colloquialize(cut).alias("text"), F.lit(cfg.spoken_category).alias("category"), parent.alias("parent_id"), F.col(text_col).alias("_whole"))
        made.append(rows.where("text <> _whole").drop("_whole"))
    if not made:
        return empty
    out = made[0] if len(made) == 1 else made[0].union(made[1])
    return out.select(record_id("text").alias("id"), "text", "category", F.lit(True).alias("synthetic"), "parent_id", F.lit("train").alias("split_name"))
