"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Each document has the exponential key -ln(u) / w, u being fixed by its id and w its quality weight; in the
order of the keys every beginning of a source is a weighted sample without replacement. A source with budget
B and T tokens is used for B // T complete epochs (at most ``max_repeats``), and the first documents by key
whose running total fits the rest once more; weights are in ``quality``. Running totals are made in two levels, by key range and within
one, so that no source, however large, is sorted in one task.

The total is, unless given, the largest at which every listed source that has documents reaches its share
(shares of those that have none go to the others in proportion). A given total is kept, and sources that
cannot fill their budget fall short of it; ``shares`` reports target, budget and what was reached.

Null sources and sources that are not listed take no part; a null max_repeats is 1. Null and empty texts have
no tokens and are never drawn. Repeated doc_ids count once. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut
from .tokens import TOKENIZERS, uniform, with_tokens

#: documents in a key range, about
RANGE = 20_000
SEED = 11
#: rounds that fill what the document at a budget's end leaves, where that is over SHORT of the budget
FILLS, SHORT = 4, 0.001


def quality(text: Column) -> Column:
    """A document's weight, in [0.1, 1]: little for texts that repeat themselves, line by line or word by word, and for texts of few letters.

    The product of the share of distinct lines, of how many distinct words there are for so long a text (their number
    over that of all words to the power 0.8, which ordinary texts keep to at any length), and of the share of letters.
    """
    lines = F.filter(F.split(text, r"\s*\n\s*"), lambda x: x != "")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", "")) / F.greatest(F.length(F.regexp_replace(text, r"\s", "")), F.lit(1))
    distinct = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    varied = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.pow(F.greatest(F.size(words), F.lit(1)), F.lit(0.8)))
    return F.round(F.greatest(F.lit(0.1), distinct * varied * F.least(F.lit(1.0), letters / 0.8)), 6)


def measured(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, key) of the documents with tokens."""
    one = docs.where("source is not null and doc_id is not null").dropDuplicates(["doc_id"]).withColumn("weight", quality(F.col("text")))
    sized = with_tokens(one, ["doc_id", "source", "weight"], folder)
    return sized.where("n_tokens > 0").withColumn("key", -F.log(uniform("doc_id", SEED)) / F.col("weight")).drop("weight")


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each listed source: target_share, max_repeats, tokens, docs, largest, budget, epochs, rest."""
    stock = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("largest"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    joined = goal.join(stock, "source", "left").na.fill(0, ["tokens", "docs", "largest"])
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    everything = Window.partitionBy(F.lit(0))  # over the listed sources, a handful of rows
    share = F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(everything))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(everything)
    return (
        joined.withColumn("share", share)
        .withColumn("budget", F.floor(F.coalesce(F.col("share") * total, F.lit(0.0)) + 1e-6).cast("long"))
        .withColumn("epochs", F.when(live, F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats").cast("long"))).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)))
        .drop("share")
    )


def _first_by_key(ranged: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens): of each source the first documents by key whose running total is within its ``rest``; those over it alone are passed by."""
    fits = ranged.join(F.broadcast(rest), "source").where(F.col("n_tokens") <= F.col("rest"))
    sums = fits.groupBy("source", "range").agg(F.sum("n_tokens").alias("here"))
    before = sums.withColumn("before", F.sum("here").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"]).drop("here")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = fits.join(before, ["source", "range"]).withColumn("running", F.sum("n_tokens").over(within) + F.col("before"))
    return placed.where("running <= rest").select("source", "doc_id", "n_tokens")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source, n_tokens, uses), and ``shares``.

    A document that would pass the budget ends the running totals; what it leaves is filled, ``FILLS`` times, by the
    next documents by key that fit.
    """
    sized = cut(measured(docs, folder))
    plan = cut(budgets(sized, targets, total_tokens))
    live = bounded(plan.where("budget > 0").select("source", "docs", "epochs", "rest"), 10_000)
    # key ranges of about RANGE documents: 1 - exp(-key * mean weight) is near uniform
    spread = (1 - F.exp(-F.col("key"))) * F.ceil(F.col("docs") / RANGE)
    ranged = sized.join(live, "source").withColumn("range", F.floor(spread).cast("int")).drop("docs", "rest")
    taken = cut(_first_by_key(ranged, plan.where("rest > 0").select("source", "rest")))
    for _ in range(FILLS):
        got = taken.groupBy("source").agg(F.sum("n_tokens").alias("got"))
        short = plan.join(got, "source", "left").select("source", "budget", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("rest")).where(F.col("rest") > SHORT * F.col("budget"))
        more = cut(_first_by_key(ranged.join(taken.select("doc_id"), "doc_id", "left_anti"), short.select("source", "rest")))
        if more.isEmpty():
            break
        taken = taken.unionByName(more)
    drawn = ranged.join(taken.select("doc_id", F.lit(1).alias("once")), "doc_id", "left").withColumn("uses", F.col("epochs") + F.coalesce("once", F.lit(0))).where("uses > 0")
    return drawn.select("doc_id", "source", "n_tokens", "uses"), plan


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each listed source: target_share, max_repeats, docs, tokens, budget, drawn_docs, drawn_tokens, actual_share."""
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn_tokens"))
    joined = plan.join(got, "source", "left").na.fill(0, ["drawn_docs", "drawn_tokens"])
    whole = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("actual_share", F.round(F.coalesce(F.try_divide("drawn_tokens", whole), F.lit(0.0)), 6)).drop("epochs", "rest", "largest")
