"""Vocabulary extension as ordered-set algebra over tables of pieces (id, piece, score, piece_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.script import is_tamil_piece

NORMAL = 1


def tamil_pieces(pieces: DataFrame, min_length: int = 1) -> DataFrame:
    """Normal pieces of Tamil letters only, at least min_length long without the word mark."""
    return pieces.where((F.col("piece_type") == NORMAL) & is_tamil_piece("piece") & (F.length(F.translate("piece", "▁", "")) >= min_length))


def ranked(pieces: DataFrame) -> DataFrame:
    """With ``rank``: 1-based by falling score, ties by id.  A vocabulary is small enough for one window."""
    return pieces.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def new_pieces(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates that the base lacks, ranked among themselves, with the overall rank they came from."""
    fresh = ranked(candidates).withColumnRenamed("rank", "overall").join(base.select("piece"), "piece", "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.orderBy("overall")))


def extension(candidates: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """The first n new pieces, and the overlapping pieces up to the same overall rank: (piece, overall, is_new)."""
    fresh = new_pieces(candidates, base).where(F.col("rank") <= n).select("piece", "overall", F.lit(True).alias("is_new"))
    cutoff = fresh.agg(F.max("overall").alias("cut"))
    shared = ranked(candidates).withColumnRenamed("rank", "overall").join(base.select("piece"), "piece", "left_semi").select("piece", "overall", F.lit(False).alias("is_new"))
    return fresh.union(shared.crossJoin(F.broadcast(cutoff)).where("overall <= cut").drop("cut"))  # one row


def rescored(base: DataFrame, chosen: DataFrame, mode: str = "tamil_first") -> DataFrame:
    """Base pieces with new scores, and the new pieces.

    tamil_first: chosen pieces, overlap included, rise above the base's best in rank order.  append: new pieces go below
    the base's worst; the base stays as it is.
    """
    if mode not in ("tamil_first", "append"):
        raise ValueError(mode)
    ends = base.where(F.col("piece_type") == NORMAL).agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    place = chosen if mode == "tamil_first" else chosen.where("is_new")
    order = place.withColumn("k", F.row_number().over(Window.orderBy("overall"))).crossJoin(F.broadcast(ends.crossJoin(F.broadcast(place.agg(F.count("*").alias("n"))))))  # one row
    score = F.col("hi") + F.col("n") - F.col("k") + 1 if mode == "tamil_first" else F.col("lo") - F.col("k")
    scored = order.select("piece", score.alias("new_score"), "is_new")
    kept = base.join(scored.drop("is_new"), "piece", "left").select("id", "piece", F.coalesce("new_score", "score").alias("score"))
    return kept.union(scored.where("is_new").select(F.lit(None).cast("int"), "piece", "new_score"))


def slots(base: DataFrame, fresh: DataFrame, unused: Column) -> DataFrame:
    """(piece, id): the k-th new piece takes the k-th unused slot, the rest is appended behind the largest id."""
    free = base.where(unused).select("id", F.row_number().over(Window.orderBy("id")).alias("rank"))
    counts = base.agg(F.max("id").alias("last"), F.count_if(unused).alias("free"))
    placed = fresh.select("piece", "rank").join(free, "rank", "left").crossJoin(F.broadcast(counts))  # one row
    return placed.select("piece", F.coalesce("id", (F.col("last") + F.col("rank") - F.col("free")).cast("int")).alias("id"))


def fingerprint(pieces: DataFrame) -> DataFrame:
    """Order-independent hash of a vocabulary: md5 of the sorted pieces."""
    return pieces.agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("piece")), "\n")).alias("fingerprint"))
