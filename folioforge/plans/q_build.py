"""Queries that build the catalogue: directory records, rating lists, enrichment, names by containment, lifted abstracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, document
from ..operators.tables import catalogue
from ..session import table
from ..sources import files
from . import sql
from .q_catalog import _BLOCK, _CASCADE

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return wrap


@query("""SELECT listing_id::VARCHAR AS journal_id, journal_name, publisher, CASE WHEN apc IS NULL THEN 'full_oa' ELSE 'subscription' END AS oa_type, homepage_url,
    list_filter(regexp_split_to_array(lower(coalesce(journal_name, '')), '[^a-z]+'), lambda w: w <> '')[1:10] AS keywords FROM listings""")
def directory_json_venues(s, d):
    """Venues from raw records of a directory; the records are the listings written as that directory writes its own."""
    words = F.filter(F.split(F.lower(F.coalesce("journal_name", F.lit(""))), "[^a-z]+"), lambda w: w != "")
    bib = F.struct(F.col("journal_name").alias("title"), F.struct(F.col("publisher").alias("name")).alias("publisher"), words.alias("keywords"), F.col("apc").isNull().alias("boai"), F.struct(F.col("homepage_url").alias("journal")).alias("ref"))
    raw = table(s, d, "listings").select(F.to_json(F.struct(F.col("listing_id").cast("string").alias("id"), bib.alias("bibjson"))).alias("record"))
    return files.doaj_venues(raw).select("journal_id", "journal_name", "publisher", "oa_type", "homepage_url", "keywords")


_NEED = "(len(coalesce(subject_tags, [])) = 0 OR array_to_string(subject_tags, '|') = 'other' OR length(trim(coalesce(scope_text, ''))) < 30)"


@query(f"""WITH {sql.CAT}, known AS (SELECT lower(trim(journal_name)) AS n, min_by({{'scope': scope_text, 'tags': subject_tags}}, pos) AS k FROM venues WHERE journal_name IS NOT NULL AND NOT {_NEED} GROUP BY 1)
    SELECT journal_id, CASE WHEN {_NEED} AND k IS NOT NULL THEN k.scope ELSE scope_text END AS scope_text, CASE WHEN {_NEED} AND k IS NOT NULL THEN k.tags ELSE subject_tags END AS subject_tags
    FROM cat LEFT JOIN known ON n = lower(trim(journal_name))""")
def venues_enriched(s, d):
    """Current records that lack scope or tags take those of another record of the same name."""
    v = table(s, d, "venues")
    known = v.where(~catalog.needs_enrichment() & F.col("journal_name").isNotNull()).select(F.col("journal_name").alias("name"), F.col("scope_text").alias("scope"), F.col("subject_tags").alias("tags"), "pos")
    return catalog.enriched(catalogue(v), known).select("journal_id", "scope_text", "subject_tags")


@query(f"""WITH {sql.CAT} SELECT journal_id, [coalesce(subject_tags[1], ''), 'CCF-' || ccf_rating, 'CCF推荐'] AS subject_tags, ccf_rating AS ccf_rank,
    CASE ccf_rating WHEN 'A' THEN 'Q1' WHEN 'B' THEN 'Q2' WHEN 'C' THEN 'Q3' END AS quartile FROM cat WHERE ccf_rating IN ('A', 'B', 'C')""")
def rating_list_rows(s, d):
    return catalog.rated(catalogue(table(s, d, "venues")))


@query(f"""WITH {_CASCADE}, q AS (SELECT entry_id, lower(trim(journal_name)) AS t, regexp_replace(lower(journal_name), '[^a-z0-9]', '', 'g') AS ab FROM typed_venues WHERE entry_id % 20 = 0),
    w AS (SELECT entry_id, min_by(journal_id, pos) AS j FROM q, cat WHERE t <> '' AND trim(coalesce(journal_name, '')) <> '' AND ((length(lower(trim(journal_name))) > 10 AND contains(t, lower(trim(journal_name))))
        OR (length(t) > 10 AND contains(lower(trim(journal_name)), t))) GROUP BY entry_id)
    SELECT entry_id, CASE WHEN e.j IS NOT NULL THEN e.j WHEN w.j IS NOT NULL THEN w.j ELSE a.j END AS journal_id, CASE WHEN e.j IS NOT NULL THEN 1 WHEN w.j IS NOT NULL THEN 2 WHEN a.j IS NOT NULL THEN 3 ELSE 4 END AS tier
    FROM q LEFT JOIN e ON e.n = q.t AND e.n <> '' LEFT JOIN a ON a.n = q.ab AND a.n <> '' LEFT JOIN w USING (entry_id)""")
def name_cascade_full(s, d):
    """The typed names of the stated query set (``entry_id`` divides by 20) against all venues, by all tiers."""
    return catalog.full_cascade(table(s, d, "typed_venues").where("entry_id % 20 = 0"), "entry_id", "journal_name", catalogue(table(s, d, "venues")))


_LIFT = f"""{_BLOCK}, se AS (SELECT paper_id, section_no, coalesce(max(CASE WHEN level > 0 THEN trim(text) END), 'Preamble') AS title,
        coalesce(string_agg(trim(text), ' ' ORDER BY page, y0, x0, block_id) FILTER (WHERE level = 0), '') AS content FROM sn GROUP BY paper_id, section_no),
    fi AS (SELECT paper_id, arg_min({{'t': title, 'c': content}}, section_no) AS f FROM se GROUP BY paper_id)"""


@query(f"""WITH {_LIFT} SELECT paper_id, CASE WHEN f.t IN ('Abstract', '摘要') THEN f.c END AS abstract, count(*) - max(CASE WHEN f.t IN ('Abstract', '摘要') THEN 1 ELSE 0 END) AS sections
    FROM se JOIN fi USING (paper_id) GROUP BY paper_id, f""")
def paper_abstracts(s, d):
    """The abstract lifted out of each paper's sections, and the number of sections left."""
    section = document.sections(table(s, d, "blocks"))
    abstract, left = document.lifted(section)
    papers = section.select("paper_id").distinct()
    n = left.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return papers.join(abstract, "paper_id", "left").join(n, "paper_id", "left").select("paper_id", "abstract", F.coalesce("n", F.lit(0)).alias("sections"))


@query(r"SELECT entry_id, regexp_replace(journal_name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g') AS spaced FROM typed_venues")
def spaced_names(s, d):
    return table(s, d, "typed_venues").select("entry_id", catalog.spaced_name(F.col("journal_name")).alias("spaced"))


@query("""SELECT match_id, list_filter(match_reasons, lambda r, i: list_position(match_reasons, r) = i) AS reasons FROM (SELECT DISTINCT match_id, match_reasons FROM venue_matches)""")
def reasons_deduplicated(s, d):
    """The reasons of each logged match, each once, in order."""
    return table(s, d, "venue_matches").select("match_id", "match_reasons").distinct().select("match_id", F.array_distinct("match_reasons").alias("reasons"))


@query(f"""WITH {sql.CAT} SELECT tag AS area, coalesce(ccf_rating, '?') AS level, journal_id FROM (SELECT journal_id, ccf_rating, unnest(list_distinct(subject_tags)) AS tag FROM cat) WHERE tag IS NOT NULL AND tag <> ''""")
def venue_area_members(s, d):
    """The members of ``venues_by_area_level``, one row for each."""
    e = catalogue(table(s, d, "venues")).select("journal_id", F.coalesce("ccf_rating", F.lit("?")).alias("level"), F.explode(F.array_distinct("subject_tags")).alias("area"))
    return e.where("area <> ''").select("area", "level", "journal_id")


@query(r"""WITH l AS (SELECT listing_id, listing_id::VARCHAR || ' ' || upper(substring(regexp_replace(coalesce(journal_name, 'x'), '\s+', '', 'g'), 1, 4)) || ' ' || coalesce(journal_name, '') || ' ' || split_part(coalesce(nullif(trim(publisher), ''), '-'), ' ', 1) || ' ' || coalesce(homepage_url, '') AS line FROM listings)
    SELECT listing_id::VARCHAR AS no, regexp_extract(line, '^\s*(\d+)\s+(\S+)\s+(.+?)\s+(\S+)\s+(https?://\S+)', 2) AS abbrev, regexp_extract(line, '^\s*(\d+)\s+(\S+)\s+(.+?)\s+(\S+)\s+(https?://\S+)', 5) AS url
    FROM l WHERE regexp_matches(line, '^\s*(\d+)\s+(\S+)\s+(.+?)\s+(\S+)\s+(https?://\S+)')""")
def directory_table_fields(s, d):
    """The fields of a printed directory's rows; the rows are the listings as such a directory prints them."""
    short = F.upper(F.substring(F.regexp_replace(F.coalesce("journal_name", F.lit("x")), r"\s+", ""), 1, 4))
    house = F.split_part(F.coalesce(F.nullif(F.trim("publisher"), F.lit("")), F.lit("-")), F.lit(" "), F.lit(1))
    line = F.concat_ws(" ", F.col("listing_id").cast("string"), short, F.coalesce("journal_name", F.lit("")), house, F.coalesce("homepage_url", F.lit("")))
    rows = table(s, d, "listings").select(F.lit("directory").alias("doc"), F.col("listing_id").alias("rec"), line.alias("line"))
    return files.directory_fields(rows).select("no", "abbrev", "url")
