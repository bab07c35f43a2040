"""Exact word search of a stated query set: the best documents of each query by a sum over shared words, block by block."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks

#: queries and documents that meet in one task; both sides hold a hashed word in eight bytes
QUERY_ROWS, CORPUS_ROWS = 16_384, 20_000
#: queries of a block that are scored at once, and groups of documents whose best scores bound the k-th
AT_ONCE, GROUPS = 128, 512
#: words of candidates that are added up at once, beside those of one query
CELLS = 2_000_000
#: what it costs to look a word up for one query, and to multiply it densely for one document, as a share of adding one posting
LOOK_UP, DENSE = 1_250, 1 / 140


def hashed(words: Column) -> Column:
    """Words as 64-bit hashes: a million distinct words share one with a chance of 3 in 100 million."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _flat(lists: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and the row of each."""
    sizes = lists.map(len).to_numpy()
    return (np.concatenate(lists.to_numpy()) if sizes.sum() else np.empty(0)).astype(kind), np.repeat(np.arange(len(lists)), sizes)


def _first_k(q: np.ndarray, d: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query; equal ones by ``d``, which counts in corpus order."""
    order = np.lexsort((d, -np.floor(score * 1e6 + 0.5), q))
    q, d, score = q[order], d[order], score[order]
    at = np.arange(len(q)) - np.searchsorted(q, q)
    return q[at < k], d[at < k], score[at < k]


def meeting(k: int, gain: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], zeros: bool, counts: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """``compare`` of ``in_blocks``: the k best documents of a part for each query of a block.

    Scores are first worked out in single precision, frequent words by a product of matrices. Documents that can be
    among the k best but for its error are then scored in double precision; ``counts`` are exact as they are.
    """

    def meet(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        ds = ds.sort_values(["pos", "d"], na_position="first").reset_index(drop=True)
        n, n_q = len(ds), len(qs)
        term_of, q_of = _flat(qs["terms"], "int64")
        weight, _ = _flat(qs["weights"], "float64")
        terms, term_of = np.unique(term_of, return_inverse=True)
        # the postings of the words that the queries have, in the order of documents
        words, d_of = _flat(ds["words"], "int64")
        at = np.searchsorted(terms, words)
        known = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == words) if len(terms) else np.empty(0, "int64")
        cells, tf = np.unique(d_of[known] * max(len(terms), 1) + at[known], return_counts=True)
        d_of, t_of = np.divmod(cells, max(len(terms), 1))
        gains = gain(tf, d_of, ds)
        ends = np.searchsorted(d_of, np.arange(n + 1))
        by_term = np.argsort(t_of, kind="stable")
        t_ends = np.searchsorted(t_of[by_term], np.arange(len(terms) + 1))
        df = np.diff(t_ends)
        by_term, gain32 = d_of[by_term], gains[by_term].astype("float32")

        dense = np.flatnonzero(np.bincount(term_of, minlength=len(terms)) * (LOOK_UP + df) > n_q * n * DENSE)
        place = np.full(len(terms), -1)
        place[dense] = np.arange(len(dense))
        wide = -(-n // GROUPS) * GROUPS
        table = np.zeros((len(dense), wide), "float32")
        for i, t in enumerate(dense):
            table[i, by_term[t_ends[t] : t_ends[t + 1]]] = gain32[t_ends[t] : t_ends[t + 1]]

        q_ends = np.searchsorted(q_of, np.arange(n_q + 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, n_q, AT_ONCE):
            stop = min(start + AT_ONCE, n_q)
            mine = slice(q_ends[start], q_ends[stop])
            q, t, w = q_of[mine] - start, term_of[mine], weight[mine]
            exact = np.zeros((stop - start, len(terms)))
            exact[q, t] = w
            near = exact[:, dense].astype("float32") @ table
            for i, x, y in zip(*(z[place[t] < 0] for z in (q, t, w))):
                here = slice(t_ends[x], t_ends[x + 1])
                near[i, by_term[here]] += np.float32(y) * gain32[here]
            top = near.reshape(stop - start, GROUPS, -1).max(axis=2)
            bound = np.partition(top, max(GROUPS - k, 0), axis=1)[:, max(GROUPS - k, 0)] if k <= GROUPS else np.full(stop - start, -np.inf)
            # the error of a sum of m products in single precision, for this one and the k-th, and of rounding
            slack = 2e-6 + 2 * (np.diff(q_ends[start : stop + 1]) + 4) * 2.0**-23 * top.max(axis=1)
            mixed = np.bincount(q, w < 0, stop - start) > 0
            if counts:  # integers up to 2 ** 24 have no error, and of many equal ones the first are kept
                i, may = np.nonzero(near[:, :n] >= np.maximum(bound, 1.0)[:, None])
                found.append(_first_k(start + i, may, near[i, may].astype("float64"), k))
                continue
            low = bound - slack
            mask = near[:, :n] >= low[:, None]
            for i in np.flatnonzero(mixed | (low <= 0)):
                if mixed[i]:  # scores below 0, or sums that may cancel: every document is scored
                    mask[i] = True
                    continue
                mask[i] = near[i, :n] > 0
                if zeros:  # documents without a word of the query, as many as can rank
                    mask[i, np.flatnonzero(near[i, :n] == 0)[:k]] = True
            row, doc = np.nonzero(mask)
            sizes = ends[doc + 1] - ends[doc]
            apart = np.cumsum(np.bincount(row, sizes, stop - start)) // CELLS  # rows that are scored at once
            for these in np.split(np.arange(len(row)), np.searchsorted(row, np.flatnonzero(np.diff(apart)) + 1)):
                i, may, size = row[these], doc[these], sizes[these]
                cell = np.repeat(ends[may] - np.cumsum(size) + size, size) + np.arange(size.sum())
                pair = np.repeat(np.arange(len(may)), size)
                found.append(_first_k(start + i, may, np.bincount(pair, exact[i[pair], t_of[cell]] * gains[cell], len(may)), k))
        q, d, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"q": qs["q"].to_numpy()[q], "d": ds["d"].to_numpy()[d], "pos": ds["pos"].to_numpy()[d], "score": score})

    return meet


class Search(NamedTuple):
    """One search of ``best_of``: the columns of the queries that hold its words (hashed, each once) and their weights (none: all 1), and what is asked of it."""

    name: str
    terms: str
    weights: str | None
    k: int
    gain: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray]
    zeros: bool
    counts: bool = False


def best_of(queries: DataFrame, qkey: str, docs: DataFrame, key: str, pos: str, searches: list[Search]) -> DataFrame:
    """(qkey, key, pos, score, search): the k best documents of each query in every part of the corpus, and so those of all, for each search.

    ``docs`` holds one row for each key, with ``words`` (hashed, with repetitions). A score is the sum of weight times
    ``gain(tf, row, docs)`` over the shared words; documents that share none score 0 and rank if ``zeros``. ``counts``:
    all weights and gains are 1. Queries whose words are null take no part in a search. All searches are made where a
    block of queries meets a part of the corpus, so both are sent there once.
    """
    kinds = dict(queries.dtypes)[qkey], dict(docs.dtypes)[key], dict(docs.dtypes)[pos]

    def meet(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        found = []
        for x in searches:
            mine = qs[qs[x.terms].notna()]
            if len(mine):
                weights = mine[x.weights] if x.weights else mine[x.terms].map(lambda t: np.ones(len(t)))
                sides = pd.DataFrame({"q": mine["q"], "terms": mine[x.terms], "weights": weights}), ds
                found.append(meeting(x.k, x.gain, x.zeros, x.counts)(*sides).assign(search=x.name))
        return pd.concat(found) if found else pd.DataFrame(columns=["q", "d", "pos", "score", "search"])

    schema = f"q {kinds[0]}, d {kinds[1]}, pos {kinds[2]}, score double, search string"
    out = in_blocks(queries.withColumnRenamed(qkey, "q"), "q", docs.withColumnsRenamed({key: "d", pos: "pos"}), "d", meet, schema, QUERY_ROWS, CORPUS_ROWS)
    return out.select(F.col("q").alias(qkey), F.col("d").alias(key), F.col("pos").alias(pos), F.round("score", 6).alias("score"), "search")


def best(queries: DataFrame, qkey: str, docs: DataFrame, key: str, pos: str, k: int, gain: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], zeros: bool, counts: bool = False) -> DataFrame:
    """(qkey, key, pos, score): ``best_of`` for one search by the columns ``terms`` and ``weights``."""
    return best_of(queries.select(qkey, "terms", "weights"), qkey, docs, key, pos, [Search("", "terms", "weights", k, gain, zeros, counts)]).drop("search")
