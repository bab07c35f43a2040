"""What stands outside of Spark: embeddings, profiles, quality, re-ranking. Each is a protocol with an offline default."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rules


class EmbeddingProvider(Protocol):
    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


class ProfileProvider(Protocol):
    def profile(self, papers: DataFrame) -> DataFrame: ...


class QualityProvider(Protocol):
    def assess(self, papers: DataFrame) -> DataFrame: ...


class RerankProvider(Protocol):
    def rerank(self, candidates: DataFrame) -> DataFrame: ...


class HashingEmbedding:
    """Signed feature hashing of words, unit length; a text without words is the zero vector."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        dim, kind = self.dim, dict(df.dtypes)[key]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for t in batch[text]:
                    v = np.zeros(dim, dtype=np.float32)
                    for w in (t or "").lower().split():
                        h = xxhash.xxh64_intdigest(w)
                        v[h % dim] += 1 if h >> 63 else -1
                    norm = float(np.linalg.norm(v))
                    rows.append((v / norm if norm else v).tolist())
                yield pd.DataFrame({key: batch[key], "embedding": rows})

        return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


class KeywordProfile:
    """Keywords by frequency, areas by the taxonomy's words: what stands in where no model profiles a paper."""

    def profile(self, papers: DataFrame) -> DataFrame:
        from ..operators.catalog import taxonomy_tags
        from ..operators.evaluate import keyword_topk

        text = papers.select("paper_id", "title", "abstract", F.concat_ws(" ", "title", "abstract").alias("t"))
        words = keyword_topk(text, "paper_id", "t").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
        out = text.join(words, "paper_id", "left")
        none = F.array().cast("array<string>")
        return out.select(
            "paper_id", "title", "abstract", F.coalesce(F.transform("w", lambda x: x["word"]), none).alias("keywords"), taxonomy_tags(F.col("t")).alias("research_area"),
            *[none.alias(c) for c in ("application_domain", "techniques", "datasets", "evaluation_metrics")],
            F.lit("method").alias("method_type"), F.lit("application").alias("paper_type"), F.lit(None).cast("string").alias("novelty"), F.lit(None).cast("string").alias("novelty_type"),
            F.lit(None).cast("double").alias("paper_strength"),
        )


class SignalQuality:
    def assess(self, papers: DataFrame) -> DataFrame:
        s = rules.strength(F.col("abstract"))
        return papers.select("paper_id", s.alias("paper_strength"), rules.strength_level(s).alias("quality_level"))


def parse_answer(content: str | None) -> object | None:
    """The JSON in a model's answer: the whole, the inside of a code fence, the first complete object or list, or what starts last."""
    text = (content or "").strip()
    if not text:
        return None
    fenced = re.search(r"```(?:\w+)?\s*\n(.*?)\n?```", text, re.DOTALL)
    decoder = json.JSONDecoder()
    for part in (text, fenced[1] if fenced else None):
        if part:
            try:
                return json.loads(part)
            except ValueError:
                pass
    for opening in "{[":
        at = text.find(opening)
        if at >= 0:
            try:
                return decoder.raw_decode(text[at:])[0]
            except ValueError:
                pass
    at = max(text.rfind("{"), text.rfind("["))
    if at > 0:
        try:
            return json.loads(text[at:])
        except ValueError:
            pass
    return None


def parsed_answers(df: DataFrame, column: str) -> DataFrame:
    """Adds ``json``: the answer's JSON as text, null where there is none."""

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        found = [parse_answer(x) for x in s]
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found])

    return df.withColumn("json", parse(column))


def retried(call: Callable, attempts: int = 3, first: float = 2.0, most: float = 8.0) -> Callable:
    """A provider's call, tried again with growing pauses."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception:
                if n == attempts - 1:
                    raise
                time.sleep(min(most, first * 2**n))
        return None

    return run


def listed(column: str):
    """A list given as text is split at commas; blanks are left out."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def prompt_candidates(ranked: DataFrame) -> DataFrame:
    """(paper_id, candidates): what a re-ranker is told of each candidate, as JSON in rule order."""
    one = F.struct(
        "rule_rank", "journal_id", "journal_name", F.slice("subject_tags", 1, 5).alias("subject_tags"), F.slice("venue_keywords", 1, 5).alias("keywords"),
        F.coalesce("ccf_rating", F.lit("未知")).alias("ccf_rating"), F.round("score", 2).alias("rule_score"), "reasons",
    )
    grouped = ranked.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return grouped.select("paper_id", F.to_json("c").alias("candidates"), tx.token_estimate(F.to_json("c")).alias("tokens"))
