"""Offline evaluation of recommendations against the venue a paper was meant for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def logged(matches: DataFrame) -> DataFrame:
    """The newest run of each paper, each venue once, ranked anew: (paper_id, journal_id, rank)."""
    newest = matches.groupBy("paper_id").agg(F.max("run_no").alias("run_no"))
    once = matches.join(newest, ["paper_id", "run_no"]).groupBy("paper_id", "journal_id").agg(F.min("match_rank").alias("match_rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("match_rank", "journal_id"))).drop("match_rank")


def hits(recommended: DataFrame, actual: DataFrame) -> DataFrame:
    """(paper_id, n, hit_rank): the number of recommendations, and the rank of the venue named in ``actual``, if any.

    Names agree without regard to case and outer space. Papers without recommendations have n 0.
    """
    want = actual.select("paper_id", tx.normal_name(F.col("venue")).alias("want")).where("paper_id is not null and want is not null").distinct()
    sizes = recommended.groupBy("paper_id").agg(F.max("rank").alias("n"))
    named = recommended.select("paper_id", "rank", F.lower("journal_name").alias("want"))
    first = want.join(named, ["paper_id", "want"]).groupBy("paper_id", "want").agg(F.min("rank").alias("hit_rank"))
    return want.join(first, ["paper_id", "want"], "left").join(sizes, "paper_id", "left").select("paper_id", "want", F.coalesce("n", F.lit(0)).alias("n"), "hit_rank")


def hit_at(k: int) -> Column:
    """A hit at 3 or 5 needs as many recommendations; one at 1 or 10 does not."""
    inside = F.coalesce(F.col("hit_rank") <= k, F.lit(False))
    return inside & (F.col("n") >= k) if k in (3, 5) else inside


def rate(count: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(count, total), F.lit(0.0)), 6)


def summary(hit: DataFrame, by: list[str] | None = None) -> DataFrame:
    cols = [F.count(F.lit(1)).alias("total"), *[F.sum(hit_at(k).cast("long")).alias(f"hit{k}") for k in (1, 3, 5, 10)]]
    out = hit.groupBy(*by).agg(*cols) if by else hit.agg(*cols)
    counts = [F.coalesce(F.col(f"hit{k}"), F.lit(0)).alias(f"hit{k}") for k in (1, 3, 5, 10)]
    return out.select(*(by or []), "total", *counts, *[rate(F.coalesce(F.col(f"hit{k}"), F.lit(0)), F.col("total")).alias(f"rate{k}") for k in (1, 3, 5, 10)])


def sweep(hit: DataFrame, coarse: list[int], final: list[int]) -> DataFrame:
    """(coarse_k, final_k, hits): hits that survive a cut of the candidates and one of the result."""
    grid = hit.sparkSession.createDataFrame([(c, f) for c in coarse for f in final], "coarse_k int, final_k int")
    per_rank = hit.groupBy("hit_rank").agg(F.count(F.lit(1)).alias("n"))  # a row for each rank
    joined = grid.join(F.broadcast(per_rank), (F.col("hit_rank") <= F.col("coarse_k")) & (F.col("hit_rank") <= F.col("final_k")), "left")
    return joined.groupBy("coarse_k", "final_k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


def keyword_topk(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(key, word, n, rank): the most frequent words of four or more Latin letters; ties by first occurrence."""
    parts = F.posexplode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+")).alias("at", "word")
    words = docs.select(key, parts).where(F.col("word").rlike("^[a-z]{4,}$"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "word", "n", "rank")
