"""Matching entities across sources without keys: collective graph linkage.

Listings and catalogue venues share attributes: parts of the name, publisher and address. Every shared
attribute opens edges and is their evidence, weighted by its rarity in the catalogue; one that many venues have
is met in as many tasks as they are times ``OVERSIZED``, and opens no edges of a listing that are sure to be too light. Meta-blocking keeps, for each listing, the
edges with at least ``KEEP`` of its strongest edge's weight. The edges left are compared in full, and their
confidence is refined in rounds. An owner, the publisher or the host of either side, is as similar to an owner of
the other side as their other venues are matched to each other; that similarity is evidence where the edge itself has
none (one side lacks the publisher or the host, so a publisher is held against the hosts that its other venues
have) or speaks against it (the owner changed its name), and so on until nothing moves.

A listing goes to its most confident venue (ties: the smaller journal_id) from ``ACCEPT`` on. Null and empty
attributes are no evidence; a listing without a name is matched to nothing. Rows of one journal_id are one venue; null journal_ids are none.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, is_small, spread_left
from .p5_names import KINDS, _tokens, distance, name_similarity, reading

OVERSIZED = 200
#: keys of so few venues give each listing's strongest edge a weight that it has at least
RARE = 50
KEEP = 0.4
ACCEPT = 0.5
#: moves below STABLE are none; rounds that are not stable after ROUNDS, or come round again, are reported
ROUNDS, STABLE, STEP = 200, 0.01, 0.9
SURE, NEIGHBOURS, ALONE = 0.8, 3.0, 1.0
#: the pairs of owners whose similarity is propagated: of a listing, and of a venue
OWNERS = (("lp", "vp"), ("lh", "vh"), ("lp", "vh"), ("lh", "vp"))
#: a host of listings of more of the catalogue's publishers than this, and of no venue, is a portal
PORTAL = 2
#: fixed values: words of a publisher's name that are not its own
FORMS = frozenset(
    "the press pr publishing publ publisher publishers pub group science verlag editions edition ed academic acad "
    "gmbh ltd inc bv b v co llc sa ag plc".split()
)
#: fixed values: what is written where a publisher is not known
NOBODY = frozenset(("unknown", "selfpublished", "independent", "societyoffice", "none", "na", "various", "author", "authors"))
#: fixed values: path parts that name no venue
PATHS = frozenset(("en", "de", "about", "index", "html", "htm", "item", "view", "home", "www", "journals", "journal", "php"))
SIDE = "name string, publisher string, host string, page string, keys array<string>"


def publisher_core(text: str | None) -> str:
    words = [w for w in re.findall(r"[^\W\d_]+", (text or "").casefold()) if w not in FORMS]
    core = "".join(words)
    return "" if core in NOBODY else core


def address_core(url: str | None) -> tuple[str, str]:
    """(host, page): the owner's label of the host, and the label or path part that names the venue."""
    text = (url or "").strip().casefold()
    m = re.match(r"^(?:[a-z]+://)?([^/?#\s]+\.[^/?#\s]+)([^?#]*)", text)
    if not m:
        return "", ""
    labels = [x for x in m[1].split(":")[0].split(".") if x != "www"]
    owner = labels[-2] if len(labels) > 1 else labels[0]
    parts = [x for x in re.split(r"[/.]", m[2]) if x and x not in PATHS and not x.isdigit()]
    page = labels[0] if len(labels) > 2 and labels[0] not in PATHS else (parts[-1] if parts else "")
    return owner, "" if re.fullmatch(r"(?:journals|read|hub)", page) else page


def name_keys(text: str) -> list[str]:
    """Blocking keys of a reading: openings of all its words, and of each two of them, with the kind."""
    acronym, tokens = _tokens(text)
    kinds = [w for w, _ in tokens if w in KINDS and w != "international"]
    body = [w[:3] for w, _ in tokens if w not in KINDS]
    kind = kinds[0][:2] if kinds else "?"
    keys = ["a:" + kind + " ".join(sorted(body))] if body else []
    keys += [f"2:{kind}{min(x, y)}{max(x, y)}" for i, x in enumerate(body) for y in body[i + 1 :]]
    return keys


def attributes(df: DataFrame, key: str) -> DataFrame:
    """(key, name, publisher, host, page, keys): distinct readings of a side's rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, name, publisher, url in zip(batch[key], batch["journal_name"], batch["publisher"], batch["homepage_url"]):
                text, core = reading(name), publisher_core(publisher)
                host, page = address_core(url)
                keys = name_keys(text)
                owners = {o[:5] for o in (core, host) if o}
                keys += [f"o:{k}{o}" for o in owners for k in keys if k[0] == "2"]
                keys += [f"u:{host}/{page}"] if host and page else []
                keys += [f"p:{page}{kd}" for kd in [text[:2]] if page and text]
                rows.append((id_, text, core, host, page, keys))
            yield pd.DataFrame(rows, columns=[key, "name", "publisher", "host", "page", "keys"])

    kind = dict(df.dtypes)[key]
    side = df.select(key, "journal_name", "publisher", "homepage_url").where(F.col(key).isNotNull()).distinct()
    return side.mapInPandas(read, f"{key} {kind}, {SIDE}").dropDuplicates([key, "name", "publisher", "host", "page"])


def candidate_edges(listing: DataFrame, venue: DataFrame) -> DataFrame:
    """(listing_id, journal_id): edges that meta-blocking keeps.

    Frequent keys, whose edges grow as the square of the tables, open none if they are too light: an edge that shares only a
    listing's lightest keys, together below ``KEEP`` of a weight that its strongest edge surely has, would not be kept.
    The light keys still count for edges that others open.
    """
    total = venue.select("journal_id").distinct().count()
    mine = Window.partitionBy("listing_id")

    def keys(df: DataFrame, side: str) -> DataFrame:
        return df.select(side, F.explode("keys").alias("k")).select(side, F.xxhash64("k").alias("k")).distinct()

    held = cut(keys(venue, "journal_id"))
    weighted = cut(held.groupBy("k").agg(F.count(F.lit(1)).alias("df")).select("k", "df", F.log(F.lit(float(total + 1)) / F.col("df")).alias("w")))
    ask = cut(keys(listing, "listing_id").join(weighted, "k"))
    rare = ask.where(F.col("df") <= RARE).join(held, "k").groupBy("listing_id", "journal_id").agg(F.sum("w").alias("w"))
    sure = ask.select("listing_id", "w").unionByName(rare.select("listing_id", "w")).groupBy("listing_id").agg((F.max("w") * (KEEP - 1e-9)).alias("least"))
    upto = F.sum("w").over(mine.orderBy("w", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = cut(ask.withColumn("upto", upto).join(sure, "listing_id").withColumn("opens", F.col("upto") >= F.col("least")), after=[ask])

    blocks = F.ceil(F.col("df") / OVERSIZED).cast("int")
    ask = marked.where("opens").select("k", "listing_id", "w", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    give = held.join(weighted, "k").select("k", "journal_id", F.pmod(F.xxhash64("journal_id"), blocks).cast("int").alias("block"))
    opened = ask.join(give, ["k", "block"]).select("listing_id", "journal_id", "w").repartition("listing_id").groupBy("listing_id", "journal_id").agg(F.sum("w").alias("part"))
    light = marked.groupBy("listing_id").agg(F.sum(F.when(~F.col("opens"), F.col("w")).otherwise(0.0)).alias("light"), F.collect_list(F.when(~F.col("opens"), F.struct("k", "w"))).alias("lights"))
    most = F.max("part").over(mine) * (KEEP - 1e-9)
    may = opened.join(light.select("listing_id", "light"), "listing_id").withColumn("most", most).where(F.col("part") + F.col("light") >= F.col("most"))
    near = cut(may.select("listing_id", "journal_id", "part"), after=[weighted])

    has = held.groupBy("journal_id").agg(F.collect_list("k").alias("has"))
    more = F.aggregate(F.filter("lights", lambda x: F.array_contains("has", x["k"])), F.lit(0.0), lambda s, x: s + x["w"])
    edges = near.join(has, "journal_id").join(light.select("listing_id", "lights"), "listing_id").select("listing_id", "journal_id", (F.col("part") + more).alias("weight"))
    kept = edges.withColumn("top", F.max("weight").over(mine)).where(F.col("weight") >= KEEP * F.col("top"))
    return cut(kept.select("listing_id", "journal_id"), after=[held, marked, near])


def _same(a: str, b: str) -> float:
    """1 the same, 0.9 but for a slip, -1 different, 0 not known on one side."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.9 if distance(a, b, 2) <= 2 and min(len(a), len(b)) > 5 else -1.0


def _scope_of(a: str, b: str) -> float:
    """An international journal is another than the journal of the same name."""
    x, y = ({w for w, _ in _tokens(t)[1]} for t in (a, b))
    return 0.5 if "journal" in x & y and ("international" in x) != ("international" in y) else 1.0


def compared(edges: DataFrame, listing: DataFrame, venue: DataFrame) -> DataFrame:
    """The edges with their evidence: name, publisher and host similarity, page agreement."""
    # a host that the catalogue lacks, with listings of several publishers that it has, is a portal: no evidence
    owners = venue.where("publisher <> ''").select("publisher").distinct()
    portal = (
        listing.where("host <> ''").join(owners, "publisher", "left_semi").groupBy("host").agg(F.countDistinct("publisher").alias("n")).where(F.col("n") > PORTAL).select("host")
        .join(venue.where("host <> ''").select("host").distinct(), "host", "left_anti").withColumn("portal", F.lit(True))
    )
    listing = spread_left(listing, portal, ["host"], "listing_id").withColumn("host", F.when(F.col("portal"), F.lit("")).otherwise(F.col("host"))).drop("portal")
    left = listing.select("listing_id", *[F.col(c).alias("l_" + c) for c in ("name", "publisher", "host", "page")])
    right = venue.select("journal_id", *[F.col(c).alias("v_" + c) for c in ("name", "publisher", "host", "page")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["name"] = [name_similarity(x, y) * _scope_of(x, y) if x and y else 0.0 for x, y in zip(b["l_name"], b["v_name"])]
            b["pub"] = [_same(x, y) for x, y in zip(b["l_publisher"], b["v_publisher"])]
            b["site"] = [_same(x, y) for x, y in zip(b["l_host"], b["v_host"])]
            b["words"] = [sum(w not in KINDS for w, _ in _tokens(y)[1]) for y in b["v_name"]]
            b["same_page"] = [float(bool(x) and x == y) for x, y in zip(b["l_page"], b["v_page"])]
            yield b[["listing_id", "journal_id", "l_publisher", "v_publisher", "l_host", "v_host", "name", "pub", "site", "words", "same_page"]]

    pairs = edges.join(left, "listing_id").join(right, "journal_id")
    schema = (
        "listing_id long, journal_id string, l_publisher string, v_publisher string, l_host string, v_host string, "
        "name double, pub double, site double, words long, same_page double"
    )
    # an edge keeps the best of its venue's spellings
    return pairs.mapInPandas(compare, schema).groupBy("listing_id", "journal_id").agg(
        F.max("name").alias("name"), F.max("words").alias("words"), F.max("same_page").alias("same_page"),
        F.max(F.struct(F.abs("pub"), "pub", "l_publisher", "v_publisher")).alias("p"),
        F.max(F.struct(F.abs("site"), "site", "l_host", "v_host")).alias("s"),
    ).select(
        "listing_id", "journal_id", "name", "words", "same_page", F.col("p.pub").alias("pub"), F.col("p.l_publisher").alias("lp"), F.col("p.v_publisher").alias("vp"),
        F.col("s.site").alias("site"), F.col("s.l_host").alias("lh"), F.col("s.v_host").alias("vh"),
    )


def _confidence(pub, site):
    """From the evidence of one edge; ``pub`` and ``site`` run from -1 (others) to 1 (the same)."""
    name = F.when(F.col("name") < 0.6, -6.0).otherwise((F.col("name") - 0.8) * 8)
    telling = F.when(F.col("words") > 3, 1.2).otherwise(0.0)
    page = F.when((F.col("same_page") > 0) & (F.col("site") > 0), 2.0).otherwise(0.0)  # a page is named after the venue: alone it repeats the name
    alone = F.when((F.col("pub") == 0) & (F.col("site") == 0), -ALONE).otherwise(0.0)  # nothing but the name: its owners' other venues have to speak for it
    odds = name + telling + page + alone + pub * F.when(pub > 0, 2.0).otherwise(2.5) + site * F.when(site > 0, 2.0).otherwise(2.5)
    return 1 / (1 + F.exp(-odds))


def _sure() -> Column:
    """How much an edge counts as a match: nothing below ``ACCEPT``, its confidence from ``SURE`` on, and no step between, so that rounds do not flip."""
    return F.col("conf") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("conf") - ACCEPT) / (SURE - ACCEPT)))


def near(scored: DataFrame) -> DataFrame:
    """(owners, a, b, matched, every, most), by the place in ``OWNERS``: the sure matches between two owners, those of the listings' owner with anyone, and with the owner that it has most of."""
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("owners"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(OWNERS)]))
    known = scored.where(F.col("name") >= SURE).select("conf", pair.alias("o")).select("conf", "o.*").where("a <> '' and b <> ''")
    # rounded, since the order of a sum, and so its last digits, differ from run to run
    both = known.groupBy("owners", "a", "b").agg(F.round(F.sum(_sure()), 6).alias("matched"), F.round(F.sum(F.greatest("conf", F.lit(0.3))), 6).alias("all"))
    every = both.groupBy("owners", "a").agg(F.sum("all").alias("every"), F.max("matched").alias("most"))
    return both.join(every, ["owners", "a"]).drop("all")


def _support(a: str, b: str) -> Column:
    """From -1 to 1: whether the two owners' other venues are matched to each other, rather than to other owners' venues; 0 if nothing is known of them."""
    sure = F.when(F.col("name") >= SURE, _sure()).otherwise(0.0)
    every = F.col(f"every_{a}_{b}") - F.when(F.col("name") >= SURE, F.greatest("conf", F.lit(0.3))).otherwise(0.0) + 1
    mine = F.greatest(F.col(f"matched_{a}_{b}") - sure, F.lit(0.0))
    most = F.greatest(F.col(f"most_{a}_{b}") - F.when(F.col(f"matched_{a}_{b}") >= F.col(f"most_{a}_{b}") - 1e-5, sure).otherwise(0.0), mine)
    return F.coalesce((2 * mine - most) / every, F.lit(0.0))


def refined(scored: DataFrame) -> DataFrame:
    """The edges with their confidence after one more round of propagation, which goes ``STEP`` of the way."""
    joined, pairs = scored, cut(near(scored))
    small = is_small(pairs)
    for i, (a, b) in enumerate(OWNERS):
        one = pairs.where(F.col("owners") == i).select(F.col("a").alias(a), F.col("b").alias(b), *[F.col(c).alias(f"{c}_{a}_{b}") for c in ("matched", "every", "most")])
        joined = spread_left(joined, one, [a, b], "listing_id", small)
    renamed = {(a, b): F.coalesce(F.try_divide(f"matched_{a}_{b}", F.col(f"every_{a}_{b}") + NEIGHBOURS), F.lit(0.0)) * 2 - 1 for a, b in OWNERS[:2]}
    pub = F.when(F.col("pub") < 0, F.greatest("pub", renamed["lp", "vp"])).when(F.col("pub") > 0, F.col("pub")).otherwise(_support("lp", "vh"))
    site = F.when(F.col("site") < 0, F.greatest("site", renamed["lh", "vh"])).when(F.col("site") > 0, F.col("site")).otherwise(_support("lh", "vp"))
    return joined.withColumn("was", F.col("conf")).withColumn("conf", F.col("conf") + STEP * (_confidence(pub, site) - F.col("conf"))).select(*scored.columns, "was")


def matches(listings: DataFrame, venues: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(journal_id, listing_id, confidence): the venue of each listing that has one."""
    listing, venue = cut(attributes(listings, "listing_id").where("name <> ''")), cut(attributes(venues, "journal_id").where("name <> ''"))
    kept = candidate_edges(listing, venue)
    edges = compared(kept, listing, venue).where("name > 0 or same_page > 0")
    scored = cut(edges.withColumn("conf", _confidence(F.col("pub"), F.col("site"))), after=[kept, listing, venue])
    states = set()
    for turn in range(1, rounds + 1):
        again = cut(refined(scored.drop("was")), after=[scored])
        state = F.sum(F.xxhash64("listing_id", "journal_id", F.round("conf", 6)).cast("decimal(38,0)"))
        moved, state = again.agg(F.coalesce(F.max(F.abs(F.col("conf") - F.col("was"))), F.lit(0.0)), state).first()
        scored = again
        if moved < STABLE:
            break
        if turn == ROUNDS or state in states:
            warnings.warn(f"confidence is not stable after {turn} rounds: the last moved it by up to {moved:.4f}", RuntimeWarning, stacklevel=2)
            break
        states.add(state)
    best = scored.where((F.col("conf") >= ACCEPT) & (F.col("name") > 0)).groupBy("listing_id").agg(F.min_by(F.struct("journal_id", "conf"), F.struct(-F.col("conf"), "journal_id")).alias("b"))
    return best.select("b.journal_id", "listing_id", F.round("b.conf", 4).alias("confidence"))
