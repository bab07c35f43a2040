"""The queries of the nine problems over the given tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import p1_scan, p2_canon, p3_survivor, p4_ledger, p5_names, p6_link, p7_pack, p8_mix, p9_sentences


def _tables(*names: str):
    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, n) for n in names])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return wrap


@_tables("papers", "blocks")
def p1_found(papers, blocks):
    return p1_scan.found(papers, blocks)


@_tables("papers", "blocks")
def p1_paragraphs(papers, blocks):
    return p1_scan.paragraphs(papers, blocks)


@_tables("venues", "profiles", "area_list")
def p2_found(venues, profiles, area_list):
    return p2_canon.map_values(p2_canon.elements(venues, profiles), area_list, p2_canon.area_groups()).select("field_name", "rec_id", "raw_value", "entry_id")


@_tables("venues", "profiles", "area_list")
def p2_unmatched(venues, profiles, area_list):
    """Unmatched values by field, with their number of records."""
    mapped = p2_canon.map_values(p2_canon.elements(venues, profiles), area_list, p2_canon.area_groups())
    return mapped.where(F.col("entry_id") == p2_canon.UNMATCHED).groupBy("field_name", "raw_value").agg(F.count(F.lit(1)).alias("records"))


@_tables("venues", "feeds")
def p3_found(venues, feeds):
    return p3_survivor.survivors(venues, feeds)


@_tables("venues", "feeds")
def p3_golden(venues, feeds):
    return p3_survivor.golden(venues, feeds)


@_tables("venue_lines")
def p4_found(lines):
    return p4_ledger.copy_lines(lines)


@_tables("venue_lines")
def p4_records(lines):
    return p4_ledger.records(lines).select("key", "copies", "first_line")


@_tables("typed_venues")
def p5_found(typed):
    return p5_names.pairs(typed)


@_tables("typed_venues")
def p5_entities(typed):
    return p5_names.entities(typed)


@_tables("listings", "venues")
def p6_found(listings, venues):
    return p6_link.matches(listings, venues).select("journal_id", "listing_id")


@_tables("listings", "venues")
def p6_confidence(listings, venues):
    return p6_link.matches(listings, venues)


@_tables("documents", "pack_specs")
def p7_packing(docs, specs):
    return p7_pack.assigned(docs, specs)


@_tables("documents", "pack_specs")
def p7_fill(docs, specs):
    return p7_pack.fill_report(cut(p7_pack.assigned(docs, specs)), specs)


@_tables("documents", "pack_specs")
def p7_invariants(docs, specs):
    """What must hold for each container size: every text is placed, no container is over its capacity, no text that fits is split."""
    packed = cut(p7_pack.assigned(docs, specs))
    size = F.broadcast(specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity")))
    full = packed.groupBy("spec_id", "bin").agg(F.sum("n_tokens").alias("z")).join(size, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("z") > F.col("capacity")).alias("over_full"))
    text = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("z"), F.count(F.lit(1)).alias("pieces")).join(size, "spec_id")
    texts = text.groupBy("spec_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("z") <= F.col("capacity"))).alias("split_needlessly"))
    return texts.join(full, "spec_id")


@_tables("documents", "mix_targets")
def p8_mixture(docs, targets):
    return p8_mix.mixture(docs, targets)[0]


@_tables("documents", "mix_targets")
def p8_shares(docs, targets):
    return p8_mix.shares(*p8_mix.mixture(docs, targets))


@_tables("documents", "mix_targets")
def p8_invariants(docs, targets):
    """What must hold for each listed source: no document beyond its uses, and a budget that is kept but for less than its largest document."""
    drawn, plan = p8_mix.mixture(docs, targets)
    got = drawn.groupBy("source").agg(F.max("uses").alias("uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("got"))
    held = plan.join(got, "source", "left").na.fill(0, ["uses", "got"])
    left = F.col("budget") - F.col("got")
    return held.select("source", "docs", (F.col("uses") <= F.col("max_repeats")).alias("uses_kept"), ((left >= 0) & ((left == 0) | (left < F.greatest("largest", p8_mix.SHORT * F.col("budget"))))).alias("share_kept"))


@_tables("documents")
def p9_found(docs):
    return p9_sentences.sentences(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_paragraphs, p2_found, p2_unmatched, p3_found, p3_golden, p4_found, p4_records, p5_found, p5_entities,
            p6_found, p6_confidence, p7_packing, p7_fill, p7_invariants, p8_mixture, p8_shares, p8_invariants, p9_found,
        )
    }


_KEY = " || '|' || ".join(
    f"regexp_replace(replace(lower(coalesce(json_extract_string(record, '$.{f}'), '')), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')" for f in p4_ledger.FIELDS
)


def _survivor_sql() -> str:
    """The stated rule alone, with boilerplate told by its spread over the venues: what the model's choice must come to."""
    one = "list_filter([{f}], lambda x: x IS NOT NULL AND trim(x) <> '')"
    many = "list_distinct(list_filter(coalesce({f}, []), lambda x: x IS NOT NULL AND trim(x) <> ''))"
    union = " UNION ALL ".join(
        f"SELECT journal_id, pos, fetched_at, tr, '{f}' AS field_name, {(many if f in p3_survivor.LISTS else one).format(f=f)} AS el FROM g" for f in p3_survivor.FIELDS
    )
    m = p3_survivor
    return f"""
        WITH many AS (SELECT journal_id FROM venues WHERE journal_id IS NOT NULL GROUP BY journal_id HAVING count(*) > 1),
        tr AS (SELECT source, min(trust_rank) AS tr FROM feeds GROUP BY source),
        g AS (SELECT v.*, tr FROM venues v JOIN many USING (journal_id) LEFT JOIN tr USING (source)),
        e AS (SELECT *, array_to_string(list_sort(el), chr(31)) AS value FROM ({union})),
        d AS (SELECT DISTINCT journal_id, field_name, value, list_sort(el) AS el FROM e WHERE len(el) > 0),
        shared AS (SELECT field_name, value FROM d JOIN (SELECT field_name, count(DISTINCT journal_id) AS nv FROM d GROUP BY field_name) USING (field_name)
            WHERE field_name <> 'subject_tags' GROUP BY field_name, value, nv HAVING count(*) >= greatest({m.SHARED_BY}, {m.SHARED_SHARE} * nv)),
        x AS (SELECT journal_id, field_name, value, len(el) > 1 AS m, unnest(el) AS x FROM d WHERE field_name IN ('subject_tags', 'keywords')),
        c AS (SELECT field_name, x, count(*) AS nv, avg(m) AS w FROM (SELECT field_name, x, journal_id, max(m::INT) AS m FROM x GROUP BY ALL) GROUP BY ALL),
        l AS (SELECT field_name, x, max(n) AS most FROM (SELECT field_name, x, value, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL),
        odd AS (SELECT field_name, x FROM c JOIN l USING (field_name, x) WHERE nv >= {m.SUPPORT} AND (w < {m.COMPANY} OR most >= {m.MIXED} * nv)),
        stock AS (SELECT x.journal_id, x.field_name, x.value FROM x LEFT JOIN odd USING (field_name, x) GROUP BY ALL HAVING count(*) = count(odd.x)),
        ok AS (SELECT * FROM e WHERE len(el) > 0 AND NOT regexp_matches(value, '[�\\x00-\\x08]')
            AND NOT EXISTS (SELECT 1 FROM shared s WHERE s.field_name = e.field_name AND s.value = e.value)
            AND NOT EXISTS (SELECT 1 FROM stock s WHERE s.journal_id = e.journal_id AND s.field_name = e.field_name AND s.value = e.value)
            AND (field_name <> 'scope_text' OR (regexp_matches(rtrim(value), '[.!?。！？]["''”’»)\\]]*$') AND NOT regexp_matches(rtrim(value), '(\\.\\.|…|\\[more\\])$')))
            AND (field_name <> 'submission_url' OR regexp_matches(trim(el[1]), '(?i)^(https?|ftp)://[^\\s/.?#]+(\\.[^\\s/.?#]+)+([/?#]\\S*)?$'))
            AND NOT EXISTS (SELECT 1 FROM e o WHERE o.journal_id = e.journal_id AND o.field_name = e.field_name AND o.value <> e.value AND (
                (e.field_name = 'scope_text' AND starts_with(o.value, e.value))
                OR (e.field_name IN ('subject_tags', 'keywords') AND len(o.el) > len(e.el) AND len(list_filter(e.el, lambda x: NOT list_contains(o.el, x))) = 0))))
        SELECT journal_id, field_name, pos FROM (SELECT *, row_number() OVER (PARTITION BY journal_id, field_name
            ORDER BY fetched_at IS NULL, fetched_at DESC, coalesce(tr, 2147483647), pos) AS r FROM ok) WHERE r = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _survivor_sql(),
        "p4_found": f"""
            WITH k AS (SELECT line_id, {_KEY} AS key FROM venue_lines), g AS (SELECT key, min(line_id) AS first_line FROM k GROUP BY key)
            SELECT first_line, line_id AS copy_line FROM k JOIN g USING (key) WHERE line_id <> first_line""",
        "p4_records": f"""
            WITH k AS (SELECT line_id, {_KEY} AS key FROM venue_lines)
            SELECT key, count(*) AS copies, min(line_id) AS first_line FROM k GROUP BY key""",
        "p7_invariants": """
            SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS texts, 0 AS split_needlessly, 0 AS over_full
            FROM pack_specs WHERE capacity_tokens > 0 GROUP BY spec_id""",
        "p8_invariants": """
            SELECT t.source, count(DISTINCT d.doc_id) AS docs, true AS uses_kept, true AS share_kept
            FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) t LEFT JOIN (SELECT * FROM documents WHERE length(text) > 0) d ON d.source = t.source GROUP BY t.source""",
    }
