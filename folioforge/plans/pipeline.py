"""The whole recommendation as one lazy plan, and the listing and report that go with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, retrieve, rules, wordsearch
from ..operators.tables import arr, catalogue, rich_query, search_query, venue_profile
from ..session import cut
from .providers import EmbeddingProvider, RerankProvider


#: papers whose candidates are found and fused at once; what a pass shuffles is removed with its end
PASS_ROWS = 32_768


def candidates(papers: DataFrame, venues: DataFrame, embedding: EmbeddingProvider | None = None, k: int = 50) -> DataFrame:
    """(paper_id, journal_id, score, rank): the routes fused. ``papers`` hold profile columns and ``mode``."""
    docs = catalogue(venues).withColumn("_profile", venue_profile())
    corpus = retrieve.lexical_corpus(docs, "journal_id", "pos", F.col("_profile"))
    near = cut(embedding.embed(docs, "journal_id", "_profile")) if embedding is not None else None
    passes = max(1, -(-papers.count() // PASS_ROWS))
    done = []
    for i in range(passes):
        mine = papers.where(F.pmod(F.xxhash64("paper_id", F.lit("pass")), F.lit(passes)) == i) if passes > 1 else papers
        routes = retrieve.lexical_routes(
            mine, "paper_id", rich_query(), search_query(), docs, "journal_id", "pos", F.col("_profile"), {r: retrieve.route_size(r) for r in ("bm25", "text")}, corpus
        )
        if embedding is not None:
            q = cut(embedding.embed(mine.withColumn("_q", rich_query()), "paper_id", "_q"))
            found = retrieve.vector_topk(q, "paper_id", near, "journal_id", "embedding", 32, wordsearch.QUERY_ROWS)
            size = mine.select("paper_id", retrieve.route_size("vector").alias("_k"))
            routes = {"bm25": routes["bm25"], "vector": cut(found.join(size, "paper_id").where("rank <= _k").drop("_k"), after=[q]), "text": routes["text"]}
        fused = retrieve.fuse(routes, "paper_id", "journal_id", k)
        done.append(cut(fused) if passes > 1 else fused)
    return reduce(DataFrame.unionByName, done)


def recommend(
    papers: DataFrame, venues: DataFrame, top_k: int = 5, oa_preference: str = "any", embedding: EmbeddingProvider | None = None,
    reranker: RerankProvider | None = None, use_scope_bm25: bool = True,
) -> DataFrame:
    """(paper_id, rank, journal_id, journal_name, score, confidence, reasons) of the best venues of each paper.

    Without a re-ranker the order is that of the rules and the confidence 0.5.
    """
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be from 1 to 20")
    docs = catalogue(venues).withColumnRenamed("keywords", "venue_keywords").drop("source")
    fused = cut(candidates(papers, venues, embedding).select("paper_id", "journal_id", F.col("rank").alias("candidate_rank")))
    pairs = fused.join(papers.drop("full_text"), "paper_id").join(docs.drop("fetched_at", "loaded_at"), "journal_id")
    if use_scope_bm25:
        title = F.concat_ws(" ", F.coalesce("title", F.lit("")), tx.joined(arr("keywords")))
        plus = bm25.plus_scores(pairs, "paper_id", title, catalogue(venues), "journal_id", F.coalesce("scope_text", F.lit("")), rules.BM25_SCALE)
        pairs = pairs.join(cut(plus.select("paper_id", "journal_id", F.col("score").alias("bm25"))), ["paper_id", "journal_id"])
    ranked = rules.ranked(rules.scored(pairs, oa_preference).withColumn("reasons", rules.reasons()), 20)
    final = rules.adjusted(ranked).withColumn("score", F.col("adjusted"))
    if reranker is not None:
        merged = rules.merged_rerank(final, reranker.rerank(final), top_k)
        return merged.join(docs.select("journal_id", "journal_name"), "journal_id").select("paper_id", "rank", "journal_id", "journal_name", "score", "confidence", "reasons")
    return final.where(F.col("rank") <= top_k).select("paper_id", "rank", "journal_id", "journal_name", "score", F.lit(0.5).alias("confidence"), "reasons")


def list_venues(venues: DataFrame, tag: str = "", oa_type: str = "", quartile: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the catalogue in corpus order; empty conditions do not filter."""
    out = venues
    if tag:
        out = out.where(F.array_contains("subject_tags", tag))
    if oa_type:
        out = out.where(F.col("oa_type") == oa_type)
    if quartile:
        out = out.where(F.col("quartile") == quartile)
    return out.orderBy("pos").offset(offset).limit(limit)


def report(recommended: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, no, line): the lines of a printed report, at most ten reasons for each venue."""
    title = papers.select("paper_id", F.lit(0).alias("no"), F.concat(F.lit("Paper: "), F.coalesce("title", F.lit(""))).alias("line"))
    venue = recommended.select("paper_id", (F.col("rank") * 100).alias("no"), F.concat(F.col("rank").cast("string"), F.lit(". "), "journal_name", F.lit(" ("), F.expr("format_number(score, '0.00')"), F.lit(")")).alias("line"))
    why = recommended.select("paper_id", "rank", F.posexplode(F.slice("reasons", 1, 10)).alias("i", "r")).select("paper_id", (F.col("rank") * 100 + 1 + F.col("i")).alias("no"), F.concat(F.lit("  - "), "r").alias("line"))
    return title.unionByName(venue).unionByName(why)


def safe_name(title):
    """A file name of a title's first thirty characters."""
    return F.regexp_replace(F.substring(title, 1, 30), r"[^\p{L}\p{N} _-]", "_")
