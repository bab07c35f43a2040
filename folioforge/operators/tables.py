"""The entities of the recommender as tables: catalogue, profiles, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut, lookup


def arr(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def last_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the last in the given order. Null keys are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def catalogue(venues: DataFrame) -> DataFrame:
    """Upsert by journal_id: the row last in corpus order survives."""
    return last_wins(venues, "journal_id", F.col("pos").desc())


def first_wins(venues: DataFrame) -> DataFrame:
    return last_wins(venues, "journal_id", F.col("pos").asc())


def venue_profile(name: str = "journal_name", scope: str = "scope_text", keywords: str = "keywords", tags: str = "subject_tags") -> Column:
    """The non-empty of name, scope, keywords and tags, joined by bars."""
    parts = F.array(F.coalesce(name, F.lit("")), F.coalesce(scope, F.lit("")), tx.joined(F.col(keywords)), tx.joined(F.col(tags)))
    return F.array_join(F.filter(parts, lambda p: p != ""), " | ")


def embedding_text() -> Column:
    """The other text by which a venue is embedded: its name and scope."""
    return F.concat(F.coalesce("journal_name", F.lit("")), F.lit(". "), F.coalesce("scope_text", F.lit("")))


def current_profiles(profiles: DataFrame) -> DataFrame:
    """The newest profile of each paper."""
    return last_wins(profiles, "paper_id", F.col("created_at").desc_nulls_last(), F.col("profile_id").desc())


def asked(papers: DataFrame, one_in: int = 20) -> DataFrame:
    """The stated query set of the searches: papers whose id divides by ``one_in``."""
    return papers.where(F.col("paper_id") % one_in == 0)


def query_text(full: bool = False) -> Column:
    parts = [F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))]
    return F.concat_ws(" ", *parts, *([F.substring(F.coalesce("full_text", F.lit("")), 1, 5000)] if full else []))


def rich_query() -> Column:
    """Keywords and techniques count twice or more by being repeated."""
    q = query_text()
    k, t, d = tx.joined(F.col("keywords")), tx.joined(F.col("techniques")), tx.joined(F.col("application_domain"))
    return F.concat_ws(" ", q, q, k, t, d, k, t, tx.joined(F.col("datasets")), tx.joined(F.col("evaluation_metrics")), F.coalesce("novelty", F.lit("")))


def search_query() -> Column:
    return F.concat_ws(" ", query_text(), tx.joined(F.col("keywords")), tx.joined(F.col("research_area")), tx.joined(F.col("techniques")))


def logged_pairs(matches: DataFrame, profiles: DataFrame, venues: DataFrame) -> DataFrame:
    """Each (paper, venue) of the recommendation log once, with its profile, its venue and what the rules need of them; those without either are left out.

    A venue with a third of the log is looked up apart from the others.
    """
    from .rules import PAPER, VENUE, prepared

    pair = cut(matches.select("paper_id", "journal_id").distinct())
    p = current_profiles(profiles).select(
        "paper_id", "title", "abstract", "research_area", "keywords", "techniques", "datasets", "evaluation_metrics", "method_type", "paper_type", "novelty_type", "paper_strength"
    )
    v = catalogue(venues).select(
        "journal_id", "pos", "journal_name", "scope_text", F.col("keywords").alias("venue_keywords"), "subject_tags", "oa_type", "target_paper_type", "ccf_rating"
    )
    held = prepared(v, VENUE).join(pair.groupBy("journal_id").agg(F.count(F.lit(1)).alias("_n")), "journal_id")
    return lookup(pair.join(prepared(p, PAPER), "paper_id"), held, ["journal_id"], "_n", pair.count())
