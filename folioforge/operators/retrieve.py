"""Keyword overlap search, exact vector search, normalisation and fusion of routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from . import bm25, wordsearch
from .blocks import in_blocks

#: fixed values: hits of each route by mode, and the weights of the routes
FAN_OUT = {"title": (22, 22, 16), "abstract": (28, 28, 14), "full": (32, 32, 16)}
WEIGHTS = {"bm25": 0.45, "vector": 0.35, "text": 0.20}
ROUTES = ("bm25", "vector", "text")
#: queries of a block that are multiplied at once
AT_ONCE = 128


def overlap_topk(queries: DataFrame, qkey: str, qtext: Column, docs: DataFrame, key: str, pos: str, dtext: Column, k: int = 14) -> DataFrame:
    """(qkey, key, score, rank): the share of a query's words that the document (one row for each key) has; only what shares one.

    Blocks of queries meet parts of the corpus, and only the k best of each part leave its task.
    """
    asked = cut(
        queries.select(qkey, wordsearch.hashed(tx.token_set(qtext)).alias("terms")).where("size(terms) > 0")
        .withColumn("weights", F.transform("terms", lambda t: F.lit(1.0)))
    )
    held = cut(docs.select(key, pos, wordsearch.hashed(tx.token_set(dtext)).alias("words")))
    shared = wordsearch.best(asked, qkey, held, key, pos, k, _one, zeros=False, counts=True)
    scored = shared.join(asked.select(qkey, F.size("terms").alias("size")), qkey).withColumn("score", F.round(F.col("score") / F.col("size"), 6))
    return topk(scored, qkey, pos, k).select(qkey, key, "score", "rank")


def lexical_corpus(docs: DataFrame, key: str, pos: str, dtext: Column) -> tuple[DataFrame, bm25.Corpus]:
    """What ``lexical_routes`` needs of the documents, for searches that are made one after another."""
    held = cut(docs.select(key, pos, wordsearch.hashed(tx.tokens(dtext)).alias("words")))
    return held, bm25.corpus_of(held)


def lexical_routes(
    queries: DataFrame, qkey: str, rich: Column, search: Column, docs: DataFrame, key: str, pos: str, dtext: Column, sizes: dict[str, Column],
    corpus: tuple[DataFrame, bm25.Corpus] | None = None,
) -> dict[str, DataFrame]:
    """The routes ``bm25`` (by ``rich``) and ``text`` (by ``search``), each (qkey, key, score, rank) up to its size.

    As ``bm25.okapi_topk`` and ``overlap_topk``, but every table is read once and both searches are made in one meeting of
    queries and corpus. ``queries`` holds one row for each key. A ``corpus`` that is given is kept.
    """
    held, counted = corpus or lexical_corpus(docs, key, pos, dtext)
    read = cut(
        queries.where(F.col(qkey).isNotNull())
        .select(qkey, wordsearch.hashed(tx.tokens(rich)).alias("words"), wordsearch.hashed(tx.token_set(search)).alias("found"), *[c.alias("k_" + r) for r, c in sizes.items()])
    )
    ranking, gain = bm25.okapi_asked(read, qkey, held, counted)
    found = F.when(F.size("found") > 0, F.col("found")).alias("found")
    asked = cut(ranking.join(read.select(qkey, found), qkey))
    most = {"bm25": max(x[0] for x in FAN_OUT.values()), "text": max(x[2] for x in FAN_OUT.values())}
    searches = [
        wordsearch.Search("bm25", "terms", "weights", most["bm25"], gain, zeros=True),
        wordsearch.Search("text", "found", None, most["text"], _one, zeros=False, counts=True),
    ]
    met = wordsearch.best_of(asked, qkey, held, key, pos, searches)
    # a query's counts of shared words are in the order of their shares
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy(qkey, "search").orderBy(F.desc("score"), pos))).where(F.col("rank") <= max(most.values()))
    share = F.when(F.col("search") == "text", F.round(F.col("score") / F.col("n"), 6)).otherwise(F.col("score"))
    sized = ranked.join(read.select(qkey, F.size("found").alias("n"), *["k_" + r for r in sizes]), qkey).withColumn("score", share)
    hits = cut(sized.where(F.col("rank") <= F.when(F.col("search") == "text", F.col("k_text")).otherwise(F.col("k_bm25"))).select(qkey, key, "score", "rank", "search"), after=[asked, read] + [held] * (corpus is None))
    return {r: hits.where(F.col("search") == r).select(qkey, key, "score", "rank") for r in most}


def _one(tf: np.ndarray, row: np.ndarray, ds: pd.DataFrame) -> np.ndarray:
    return np.ones(len(tf))


def topk(scored: DataFrame, qkey: str, tie: str, k: int | Column) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), tie)))
    return ranked.where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, qkey: str, docs: DataFrame, key: str, vector: str, k: int = 10, query_rows: int | None = None) -> DataFrame:
    """(qkey, key, score, rank): exact nearest neighbours; the score is the negative squared distance.

    The stated queries meet all documents block by block: a task multiplies matrices, works out the distances of
    what can be among the k best, and passes on only those. Vectors of another length than the query's and
    vectors with a null element are left out.
    """

    def side(df: DataFrame, name: str, short: str) -> DataFrame:
        return df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(name).alias(short), F.col(vector).alias(short + "v"))

    def nearest(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        sizes = ds["dv"].map(len)
        for size, mine in qs.groupby(qs["qv"].map(len)):
            held = ds[sizes == size]
            if size == 0 or held.empty:
                continue
            b, ids = np.stack(held["dv"].to_numpy()).astype(np.float64), held["d"].to_numpy()
            norms, n = (b * b).sum(axis=1), min(k, len(held))
            for start in range(0, len(mine), AT_ONCE):
                some = mine.iloc[start : start + AT_ONCE]
                a = np.stack(some["qv"].to_numpy()).astype(np.float64)
                near = (a * a).sum(axis=1)[:, None] + norms[None, :] - 2 * a @ b.T
                # the product rounds differently than the distance: what is as near as the k-th but for that is worked out
                most = np.partition(near, n - 1, axis=1)[:, n - 1] + 4e-6 + 1e-9 * (norms.max() + (a * a).sum(axis=1))
                for i, q in enumerate(some["q"]):
                    may = np.flatnonzero(near[i] <= most[i])
                    dist = ((b[may] - a[i]) ** 2).sum(axis=1).round(6)
                    best = np.lexsort((ids[may], dist))[:k]
                    found.append(pd.DataFrame({"q": q, "d": ids[may][best], "score": -dist[best]}))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "d": [], "score": []})

    kinds = dict(queries.dtypes)[qkey], dict(docs.dtypes)[key]
    near = in_blocks(side(queries, qkey, "q"), "q", side(docs, key, "d"), "d", nearest, f"q {kinds[0]}, d {kinds[1]}, score double", query_rows)
    return topk(near, "q", "d", k).select(F.col("q").alias(qkey), F.col("d").alias(key), "score", "rank")


def min_max(by: list[str], equal: float) -> Column:
    """Scores of each group in 0..1; where all are equal, ``equal``."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return F.when(high == low, F.lit(equal)).otherwise((F.col("score") - low) / (high - low))


def fuse(routes: dict[str, DataFrame], qkey: str, key: str, k: int = 50, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(qkey, key, score, rank): normalised scores summed by weight; ties as first met, route by route."""
    parts = None
    for name, hits in routes.items():
        no = ROUTES.index(name)
        normed = hits.withColumn("norm", min_max([qkey], 0.0) * weights[name]).select(qkey, key, "norm", (F.lit(no * 1000) + F.col("rank")).alias("met"))
        parts = normed if parts is None else parts.unionByName(normed)
    summed = parts.groupBy(qkey, key).agg(F.round(F.sum("norm"), 6).alias("score"), F.min("met").alias("met"))
    return topk(summed, qkey, "met", k).select(qkey, key, "score", "rank")


def route_size(route: str) -> Column:
    """Hits that a paper's mode asks of a route; an unknown mode is that of abstracts."""
    i = ROUTES.index(route)
    return F.when(F.col("mode") == "title", FAN_OUT["title"][i]).when(F.col("mode") == "full", FAN_OUT["full"][i]).otherwise(FAN_OUT["abstract"][i])
