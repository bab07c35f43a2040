"""Best representative of each duplicate group: a latent two-sided quality model fitted by EM.

A fact is a value of a venue's field, true if it is whole. Its voters are the feeds, which carry or omit the
values of the venues that they cover, checks of the value itself (``DEFINING``: a whole value passes them, whatever
else passes), and signals from the table: whether unrelated venues share the value, whether a text
speaks of its venue, whether the elements of a list are seen in other lists and with other elements. By field, each
voter has a sensitivity P(yes | true) and a specificity P(no | false); expectation-maximisation infers them together
with the truth of every fact, so the data say what an omission or a shared text is worth. Facts are first
aggregated to patterns of votes, so that a round reads patterns and not rows. A voter that knows nothing of a fact
(an element in too few venues) has no vote on it.

``survivors`` takes wholeness from the posterior (0.5 or more), and among the values held whole the latest
``fetched_at`` (null is the oldest), the smaller ``trust_rank`` (an unknown feed is last), the smaller ``pos``.
``golden`` runs the same model over the elements of lists and keeps every element judged true.

Null journal_ids form no group. Null, empty and blank values are no claims. A feed that ``feeds`` lacks votes
under its own name. Tables without duplicate groups give no rows.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut, lookup

FIELDS = ("scope_text", "submission_url", "subject_tags", "keywords")
LISTS = ("subject_tags", "keywords")
MARK = "\x1f"
#: what a whole value passes by its definition; the sensitivity of these checks is not inferred
DEFINING, SURE = ("intact", "ended", "link", "full"), 1 - 1e-6
SIGNALS = ("alone", "related", "company", "mixed")
#: a value is shared from so many venues on, and from this share of the venues on
SHARED_BY, SHARED_SHARE = 3, 0.002
#: an element is judged by its company from so many venues on: it keeps none if it is listed with others in less than
#: COMPANY of them, and is not mixed if one list makes up MIXED of them
SUPPORT, COMPANY, MIXED = 10, 0.1, 0.5
#: rounds end when no quality moves by STABLE; so many that are not stable are reported
ROUNDS, STABLE = 500, 1e-3
TRUE_FROM = 0.5


def values(venues: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row for each row and field of a duplicate group: elements, ``value`` (their joint text), and the row's own words ``about`` the venue."""
    many = venues.groupBy("journal_id").count().where("count > 1 and journal_id is not null").select("journal_id")
    rank = bounded(feeds.groupBy("source").agg(F.min("trust_rank").alias("trust_rank")), 10_000)
    grouped = venues.join(many, "journal_id").join(rank, "source", "left")

    def elements(f: str) -> Column:
        return F.col(f) if f in LISTS else F.array(F.col(f))

    entries = F.array(*[F.struct(F.lit(f).alias("field"), elements(f).alias("raw")) for f in FIELDS])
    about = F.concat_ws(" ", "journal_name", F.array_join(F.coalesce("keywords", F.array()), " "), F.array_join(F.coalesce("subject_tags", F.array()), " "))
    long = grouped.select(
        "journal_id", "pos", "fetched_at", "trust_rank", F.coalesce("source", F.lit("?")).alias("feed"), about.alias("about"), F.explode(entries).alias("e")
    ).select("journal_id", "pos", "fetched_at", "trust_rank", "feed", F.when(F.col("e.field") == "scope_text", F.col("about")).alias("about"), "e.field", "e.raw")
    kept = F.filter("raw", lambda x: x.isNotNull() & (F.trim(x) != ""))
    held = F.array_distinct(F.coalesce(kept, F.array().cast("array<string>")))
    return long.withColumn("elements", held).withColumn("value", F.array_join(F.array_sort("elements"), MARK)).drop("raw")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)


def facts(vals: DataFrame) -> DataFrame:
    """The distinct values of each venue and field, with the feeds that carry them and every check and signal; null is no vote."""
    text, url, listed = F.col("field") == "scope_text", F.col("field") == "submission_url", F.col("field").isin(*LISTS)
    one = F.get(F.col("elements"), F.lit(0))
    speaks = F.when(text, F.arrays_overlap(_words(one), _words(F.col("about"))))
    fact = cut(
        vals.where("value <> ''").withColumn("speaks", speaks).groupBy("journal_id", "field", "value")
        .agg(F.first("elements").alias("elements"), F.collect_set("feed").alias("asserted"), F.max("speaks").alias("related"))
    )
    venues = fact.groupBy("field").agg(F.count_distinct("journal_id").alias("of"))
    shared = (
        fact.where("field <> 'subject_tags'").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(venues), "field")
        .where((F.col("n") >= SHARED_BY) & (F.col("n") >= SHARED_SHARE * F.col("of"))).select("field", "value", F.lit(False).alias("own"))
    )
    # at most 1 / SHARED_SHARE shared values for each value that a venue has on average
    marked = fact.join(F.broadcast(shared), ["field", "value"], "left").join(_proper_parts(fact).withColumn("is_part", F.lit(True)), ["journal_id", "field", "value"], "left")
    marked = marked.join(_odd_lists(fact), ["journal_id", "field", "value"], "left")
    return cut(marked.select(
        "journal_id", "field", "value", "elements", "asserted",
        (~F.col("value").rlike("[�\\x00-\\x08]")).alias("intact"),
        F.when(text, F.rtrim("value").rlike(r"[.!?。！？][\"'”’»)\]]*$") & ~F.rtrim("value").rlike(r"(\.\.|…|\[more\])$")).alias("ended"),
        F.when(url, F.trim(one).rlike(r"^(?i)(https?|ftp)://[^\s/.?#]+(\.[^\s/.?#]+)+([/?#]\S*)?$")).alias("link"),
        F.when(~url, F.col("is_part").isNull()).alias("full"),
        F.when(F.col("field") != "subject_tags", F.coalesce("own", F.lit(True))).alias("alone"), "related",
        F.when(listed, F.coalesce(F.col("unaccompanied") < F.size("elements"), F.lit(True))).alias("company"),
        F.when(listed, F.coalesce(F.col("unmixed") < F.size("elements"), F.lit(True))).alias("mixed"),
    ))


def _proper_parts(fact: DataFrame) -> DataFrame:
    """Distinct values that are a proper subset (lists) or a proper opening (texts) of another value of the venue."""
    lists = fact.where(F.col("field").isin(*LISTS)).select("journal_id", "field", "value", "elements")
    each = lists.withColumn("link", F.explode("elements"))
    # a list meets only those that have its rarest element
    known = each.groupBy("journal_id", "field", "link").agg(F.count(F.lit(1)).alias("n"))
    a = each.join(known, ["journal_id", "field", "link"]).groupBy("journal_id", "field", "value").agg(F.first("elements").alias("small"), F.min_by("link", F.struct("n", "link")).alias("link"))
    b = each.select("journal_id", "field", F.col("elements").alias("big"), "link")
    subset = a.join(b, ["journal_id", "field", "link"]).where((F.size("small") < F.size("big")) & (F.size(F.array_except("small", "big")) == 0))
    texts = fact.where("field = 'scope_text'").select("journal_id", "field", "value")
    order = Window.partitionBy("journal_id", "field").orderBy("value")
    # in the order of the texts, one that begins any other begins the next
    opening = texts.withColumn("next", F.lead("value").over(order)).where(F.expr("startswith(next, value)"))
    return subset.select("journal_id", "field", "value").unionByName(opening.select("journal_id", "field", "value")).distinct()


def _odd_lists(fact: DataFrame) -> DataFrame:
    """(journal_id, field, value, unaccompanied, unmixed): lists with their number of elements that keep no company, or that one list alone has."""
    each = fact.where(F.col("field").isin(*LISTS)).select("journal_id", "field", "value", (F.size("elements") > 1).alias("many"), F.explode("elements").alias("element"))
    by_venue = each.groupBy("field", "element", "journal_id").agg(F.max(F.col("many").cast("int")).alias("many"))
    company = by_venue.groupBy("field", "element").agg(F.count(F.lit(1)).alias("venues"), F.avg("many").alias("with"))
    by_list = each.groupBy("field", "element", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "element").agg(F.max("n").alias("most"), F.sum("n").alias("lists"))
    odd = cut(
        company.where(F.col("venues") >= SUPPORT).join(by_list, ["field", "element"])
        .select("field", "element", "lists", (F.col("with") < COMPANY).cast("int").alias("lone"), (F.col("most") >= MIXED * F.col("venues")).cast("int").alias("same"))
        .where("lone + same > 0")
    )
    total = odd.agg(F.sum("lists")).first()[0] or 0
    met = lookup(each.select("journal_id", "field", "value", "element"), odd, ["field", "element"], "lists", total)
    return met.groupBy("journal_id", "field", "value").agg(F.sum("lone").alias("unaccompanied"), F.sum("same").alias("unmixed"))


def votes(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``pattern``, the sorted array of (voter, yes) of each fact, to (journal_id, field, asserted, the checks and signals)."""
    cover = claims.select("journal_id", "field", F.explode("asserted").alias("feed")).groupBy("journal_id", "field").agg(F.collect_set("feed").alias("covering"))
    by_feed = F.transform("covering", lambda f: F.struct(f.alias("voter"), F.array_contains("asserted", f).alias("yes")))
    by_check = F.filter(F.array(*[F.struct(F.lit(f"={c}").alias("voter"), F.col(c).alias("yes")) for c in (*DEFINING, *SIGNALS)]), lambda v: v["yes"].isNotNull())
    return claims.join(cover, ["journal_id", "field"]).select(*keys, F.array_sort(F.concat(by_feed, by_check)).alias("pattern"))


def _start() -> Column:
    """Before any quality is known: the share of the signals that say yes, nothing if a defining check says no."""
    fails = F.exists("pattern", lambda v: v["voter"].isin(*[f"={c}" for c in DEFINING]) & ~v["yes"])
    soft = F.filter("pattern", lambda v: v["voter"].isin(*[f"={c}" for c in SIGNALS]))
    share = F.when(F.size(soft) > 0, F.size(F.filter(soft, lambda v: v["yes"])) / F.size(soft)).otherwise(1.0)
    return F.when(fails, 0.05).otherwise(0.05 + 0.9 * share)


def _posterior(quality: dict[tuple[str, str], tuple[float, float]], prior: dict[str, float]) -> Column:
    """The probability of a pattern of votes, from the qualities of all voters: one map of a few dozen numbers."""
    said: list[Column] = []
    for (field, voter), (sens, spec) in quality.items():
        for yes, odds in (("+", math.log(sens / (1 - spec))), ("-", math.log((1 - sens) / spec))):
            said += [F.lit(f"{field}{MARK}{voter}{yes}"), F.lit(odds)]
    base = [x for f, p in prior.items() for x in (F.lit(f), F.lit(math.log(p / (1 - p))))]
    weight = F.create_map(*said)
    key = lambda v: F.concat(F.col("field"), F.lit(MARK), v["voter"], F.when(v["yes"], "+").otherwise("-"))
    odds = F.aggregate("pattern", F.element_at(F.create_map(*base), F.col("field")), lambda acc, v: acc + F.element_at(weight, key(v)))
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))


def fit(patterned: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[tuple[str, str], tuple[float, float]]]:
    """EM over the patterns of votes: (field, pattern, p_true), and the (sensitivity, specificity) of each (field, voter).

    The qualities, a pair for each voter and field, are all that comes to the driver. Pseudo-counts of one fact keep
    rare voters sane. Without a round, the posterior is the share of the signals that say yes.
    """
    patterns = cut(patterned.groupBy("field", "pattern").agg(F.count(F.lit(1)).alias("n")))
    p, quality, prior = _start(), {}, {}
    for turn in range(1, rounds + 1):
        vote = patterns.select("field", "n", p.alias("p"), F.explode("pattern").alias("v")).select("field", "n", "p", "v.voter", F.col("v.yes").cast("int").alias("yes"))
        true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        rows = vote.groupBy("field", "voter").agg(F.sum(true).alias("t"), F.sum(true * F.col("yes")).alias("ty"), F.sum(false).alias("f"), F.sum(false * (1 - F.col("yes"))).alias("fn")).collect()
        fixed = {f"={c}" for c in DEFINING}
        new = {(r.field, r.voter): (SURE if r.voter in fixed else (r.ty + 4) / (r.t + 5), (r.fn + 1) / (r.f + 2)) for r in rows}
        prior = {r.field: (r.t + 1) / (r.t + r.f + 2) for r in rows if r.voter == "=intact"}
        moved = max((abs(a - b) for k in new for a, b in zip(new[k], quality.get(k, (9.0, 9.0)))), default=0.0)
        quality = new
        if not quality:
            break
        p = _posterior(quality, prior)
        if moved < STABLE:
            break
        if turn == rounds and rounds == ROUNDS:
            warnings.warn(f"qualities are not stable after {rounds} rounds: the last moved one by {moved:.4f}", RuntimeWarning, stacklevel=2)
    return patterns.select("field", "pattern", p.alias("p_true")), quality


def judged(fact: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``keys`` of the facts, with ``p_true``."""
    cast = cut(votes(fact, keys))
    post, _ = fit(cast, rounds)
    return cast.join(post, ["field", "pattern"]).select(*keys, "p_true")


def survivors(venues: DataFrame, feeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(journal_id, field_name, pos): the row whose value survives. No row where no value is whole."""
    vals = cut(values(venues, feeds))
    keys = ["journal_id", "field", "value"]
    whole = judged(facts(vals), keys, rounds).where(F.col("p_true") >= TRUE_FROM).select(*keys)
    first = F.min_by(
        "pos",
        F.struct(
            F.when(F.col("fetched_at").isNull(), 1).otherwise(0), (-F.unix_micros("fetched_at")), F.coalesce("trust_rank", F.lit(2**31 - 1)), "pos"
        ),
    )
    return vals.join(whole, keys).groupBy("journal_id", F.col("field").alias("field_name")).agg(first.alias("pos"))


def golden(venues: DataFrame, feeds: DataFrame) -> DataFrame:
    """(journal_id, field_name, surviving, p_true): the single value held most likely whole; of lists every element judged true."""
    fact = facts(cut(values(venues, feeds)))
    held = [*DEFINING, *SIGNALS]
    # an element is as good as the best list that has it; that a list lacks others says nothing against it
    element = fact.select("journal_id", "field", F.explode("elements").alias("value"), "asserted", *held).groupBy("journal_id", "field", "value").agg(
        F.array_distinct(F.flatten(F.collect_set("asserted"))).alias("asserted"),
        *[F.max(F.when(~F.col("field").isin(*LISTS), F.col(c))).alias(c) if c in ("full", "alone") else F.max(c).alias(c) for c in held],
    )
    p = judged(element, ["journal_id", "field", "value"]).where(F.col("p_true") >= TRUE_FROM)
    by = ["journal_id", F.col("field").alias("field_name")]
    lists = p.where(F.col("field").isin(*LISTS)).groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("surviving"), F.round(F.avg("p_true"), 4).alias("p_true"))
    best = F.max_by(F.struct("value", "p_true"), F.struct("p_true", "value"))
    single = p.where(~F.col("field").isin(*LISTS)).groupBy(*by).agg(best.alias("b")).select("journal_id", "field_name", F.array("b.value").alias("surviving"), F.round("b.p_true", 4).alias("p_true"))
    return lists.unionByName(single)
