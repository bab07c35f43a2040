"""BM25 as joins over postings: Okapi for retrieval, Plus for the rule score.

Okapi (k1 1.5, b 0.75): idf = ln(N - df + .5) - ln(df + .5), a negative idf becomes a quarter of the mean idf
of the vocabulary; a query term counts as often as it occurs. Plus (delta 1): idf = ln((N + 1) / df), and every
document earns idf * delta for each known query term.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from . import wordsearch

K1, B, EPSILON, DELTA = 1.5, 0.75, 0.25, 1.0
#: no longer read, since hot terms are met block by block; a test sets it
SALTED = 50_000


def index(docs: DataFrame, key: str, text: Column, lower: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (key, term, tf, dl), terms (term, df, idf_okapi, idf_plus) and the one-row corpus (n, avgdl)."""
    tokened = docs.select(key, tx.tokens(text, lower).alias("_t"))
    sized = tokened.withColumn("dl", F.size("_t"))
    corpus = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = sized.select(key, "dl", F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    return postings, weighted(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus), corpus


def weighted(counted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf_okapi, idf_plus) of the terms' document counts (term, df)."""
    df = counted.crossJoin(F.broadcast(corpus))  # corpus is one row
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"), F.log((F.col("n") + 1) / F.col("df")).alias("idf_plus"))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf_okapi"), "idf_plus")


def query_terms(queries: DataFrame, key: str, text: Column, lower: bool = True) -> DataFrame:
    """(key, term, qn)"""
    return queries.select(key, F.explode(tx.tokens(text, lower)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("qn"))


def _length_norm() -> Column:
    return K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))


def okapi_topk(queries: DataFrame, qkey: str, qtext: Column, docs: DataFrame, key: str, pos: str, dtext: Column, k: int = 10) -> DataFrame:
    """(qkey, key, score, rank): the k best of all documents (one row for each key), ties in corpus order.

    Documents without a query term score 0 and may rank, since a score can be negative. Blocks of queries meet parts of
    the corpus, and only the k best of each part leave its task (``wordsearch``), so what is written grows with queries
    times k, and not with the postings that the queries' common words have.
    """
    held = cut(docs.select(key, pos, wordsearch.hashed(tx.tokens(dtext)).alias("words")))
    asked, gain = okapi_asked(queries.select(qkey, wordsearch.hashed(tx.tokens(qtext)).alias("words")), qkey, held)
    found = wordsearch.best(cut(asked), qkey, held, key, pos, k, gain, zeros=True)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), pos)))
    return ranked.where(F.col("rank") <= k).select(qkey, key, "score", "rank")


class Corpus(NamedTuple):
    """Of documents' words: (term, idf_okapi, ...), and the mean number of words."""

    terms: DataFrame
    avgdl: float


def corpus_of(held: DataFrame) -> Corpus:
    corpus = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"))
    counted = held.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Corpus(cut(weighted(counted, corpus)), corpus.first()["avgdl"] or 1.0)


def okapi_asked(queries: DataFrame, qkey: str, held: DataFrame, corpus: Corpus | None = None) -> tuple[DataFrame, Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray]]:
    """(qkey, terms, weights) of queries (qkey, words) against the documents' words (both hashed, with repetitions), and the gain of a word in a document."""
    terms, avgdl = corpus or corpus_of(held)
    q = queries.select(qkey, F.explode("words").alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("qn"))
    known = q.join(terms.select("term", "idf_okapi"), "term").groupBy(qkey).agg(F.collect_list(F.struct("term", (F.col("qn") * F.col("idf_okapi")).alias("w"))).alias("x"))
    asked = queries.select(qkey).where(F.col(qkey).isNotNull()).distinct().join(known, qkey, "left").select(
        qkey, F.coalesce("x.term", F.array().cast("array<bigint>")).alias("terms"), F.coalesce("x.w", F.array().cast("array<double>")).alias("weights")
    )

    def gain(tf: np.ndarray, row: np.ndarray, ds: pd.DataFrame) -> np.ndarray:
        dl = ds["words"].map(len).to_numpy()[row]
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    return asked, gain


def plus_scores(pairs: DataFrame, qkey: str, qtext: Column, docs: DataFrame, key: str, dtext: Column, fixed: str) -> DataFrame:
    """(qkey, key, score) of the given pairs, as a share of the best document's score for the ``fixed`` query."""
    postings, terms, corpus = index(docs, key, dtext, lower=False)
    pt = postings.join(terms.select("term", "idf_plus"), "term").crossJoin(F.broadcast(corpus))
    gain = F.col("idf_plus") * F.col("tf") * (K1 + 1) / (_length_norm() + F.col("tf"))
    weights = pt.select(key, "term", gain.alias("gain"))
    one = queries_one(docs.sparkSession, fixed).join(terms.select("term", "idf_plus"), "term")
    base = one.agg(F.coalesce(F.sum(F.col("qn") * F.col("idf_plus") * DELTA), F.lit(0.0)).alias("base"))
    best = one.join(weights, "term").groupBy(key).agg(F.sum(F.col("qn") * F.col("gain")).alias("g")).agg(F.max("g").alias("g"))
    norm = base.crossJoin(best).select(F.when(F.col("base") + F.coalesce("g", F.lit(0.0)) > 0, F.col("base") + F.coalesce("g", F.lit(0.0))).otherwise(F.lit(1.0)).alias("norm"))
    q = query_terms(pairs.select(qkey, qtext.alias("_q")).distinct(), qkey, F.col("_q"), lower=False)
    known = q.join(terms.select("term", "idf_plus"), "term")
    floor = known.groupBy(qkey).agg(F.sum(F.col("qn") * F.col("idf_plus") * DELTA).alias("floor"))
    hit = pairs.select(qkey, key).join(known, qkey).join(weights, [key, "term"]).groupBy(qkey, key).agg(F.sum(F.col("qn") * F.col("gain")).alias("hit"))
    out = pairs.select(qkey, key).join(floor, qkey, "left").join(hit, [qkey, key], "left").crossJoin(F.broadcast(norm))
    return out.select(qkey, key, F.round((F.coalesce("floor", F.lit(0.0)) + F.coalesce("hit", F.lit(0.0))) / F.col("norm"), 6).alias("score"))


def queries_one(spark, text: str) -> DataFrame:
    terms = text.split()
    return spark.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, qn long")
