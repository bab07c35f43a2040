"""Queries of the catalogue, of documents' structure and of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, document, evaluate, rules
from ..operators.tables import catalogue, current_profiles, first_wins
from ..sources import files
from ..streaming import events
from ..session import table
from . import sql
from .pipeline import list_venues, report, safe_name

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return wrap


@query("SELECT pos, journal_id, journal_name FROM venues WHERE list_contains(subject_tags, 'ai') AND oa_type = 'full_oa' ORDER BY pos LIMIT 20 OFFSET 5")
def list_venues_filtered(s, d):
    return list_venues(table(s, d, "venues"), tag="ai", oa_type="full_oa", limit=20, offset=5).select("pos", "journal_id", "journal_name")


@query("SELECT count(*) AS total, count_if(list_contains(subject_tags, 'ai')) AS filtered_total FROM venues")
def list_venues_totals(s, d):
    return table(s, d, "venues").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.array_contains("subject_tags", "ai")).alias("filtered_total"))


@query("SELECT journal_id, pos, journal_name FROM (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY pos) AS r FROM venues WHERE journal_id IN (SELECT journal_id FROM venue_matches)) WHERE r = 1")
def venue_lookup(s, d):
    """The first record of every recommended id."""
    wanted = table(s, d, "venue_matches").select("journal_id").distinct()
    return first_wins(table(s, d, "venues").join(wanted, "journal_id", "left_semi")).select("journal_id", "pos", "journal_name")


@query("SELECT journal_id, min(pos) AS pos FROM venues WHERE journal_id IS NOT NULL GROUP BY journal_id")
def dedup_first_wins(s, d):
    return first_wins(table(s, d, "venues")).select("journal_id", "pos")


@query("SELECT journal_id, max(pos) AS pos FROM venues WHERE journal_id IS NOT NULL GROUP BY journal_id")
def upsert_last_wins(s, d):
    return catalogue(table(s, d, "venues")).select("journal_id", "pos")


@query("SELECT DISTINCT journal_id FROM venue_matches WHERE journal_id NOT IN (SELECT journal_id FROM venues WHERE source = 'rating_table' AND journal_id IS NOT NULL)")
def anti_new_ids(s, d):
    v = table(s, d, "venues").where("source = 'rating_table'")
    return catalog.new_ids(table(s, d, "venue_matches").select("journal_id").distinct(), v)


@query(f"""WITH {sql.CAT} SELECT journal_id, pos, coalesce(quartile, CASE WHEN oa_type = 'full_oa' THEN 'Q2' ELSE 'Q3' END) AS quartile, coalesce(sqr_rank, 100) AS sqr_rank,
    round(CASE WHEN coalesce(impact_like_score, 0) <> 0 THEN impact_like_score WHEN coalesce(sqr_rank, 0) <> 0 THEN greatest(0.1, 10 - sqr_rank / 20) ELSE 3.0 END::DOUBLE, 6) AS impact_like_score,
    coalesce(review_time, '3-6 months') AS review_time, array_to_string(coalesce(target_paper_type, ['method', 'experiment']), ',') AS target_paper_type,
    coalesce(submission_url, homepage_url, '') AS submission_url, coalesce(apc, 0) AS apc,
    CASE WHEN coalesce(scope_text, '') <> '' THEN scope_text ELSE array_to_string(coalesce(keywords, [])[1:10], ', ') END AS scope_text FROM cat""")
def catalog_defaults(s, d):
    return catalog.with_defaults(catalogue(table(s, d, "venues")))


@query("SELECT pos, CASE ccf_rating WHEN 'A' THEN 'Q1' WHEN 'B' THEN 'Q2' WHEN 'C' THEN 'Q3' END AS from_rating FROM venues")
def rating_to_quartile(s, d):
    return table(s, d, "venues").select("pos", catalog.rating_quartile(F.col("ccf_rating")).alias("from_rating"))


@query(f"""WITH {sql.CAT} SELECT coalesce(oa_type, '?') AS oa_type, coalesce(ccf_rating, '?') AS ccf_rating, count(*) AS venues, count_if(coalesce(scope_text, '') <> '') AS with_scope,
    count_if(contains(coalesce(scope_text, ''), 'Key topics include')) AS template_scope FROM cat GROUP BY ALL""")
def catalog_stats(s, d):
    scope = F.coalesce("scope_text", F.lit(""))
    return catalogue(table(s, d, "venues")).groupBy(F.coalesce("oa_type", F.lit("?")).alias("oa_type"), F.coalesce("ccf_rating", F.lit("?")).alias("ccf_rating")).agg(
        F.count(F.lit(1)).alias("venues"), F.count_if(scope != "").alias("with_scope"), F.count_if(F.contains(scope, F.lit("Key topics include"))).alias("template_scope")
    )


@query("SELECT pos, (len(coalesce(subject_tags, [])) = 0 OR array_to_string(subject_tags, '|') = 'other' OR length(trim(coalesce(scope_text, ''))) < 30) AS needs FROM venues")
def needs_enrichment(s, d):
    return table(s, d, "venues").select("pos", catalog.needs_enrichment().alias("needs"))


_TAX = ", ".join(f"CASE WHEN len(list_filter({[w.lower() for w in ws]}, lambda w: contains(lower(coalesce(text, '')), w))) > 0 THEN '{t}' END" for t, ws in catalog.TAXONOMY.items())


@query(f"SELECT doc_id, list_sort(list_filter([{_TAX}], lambda t: t IS NOT NULL)) AS tags FROM documents")
def taxonomy_tags(s, d):
    return table(s, d, "documents").select("doc_id", catalog.taxonomy_tags(F.col("text")).alias("tags"))


_SUBJ = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in catalog.SUBJECT_RULES)


@query(f"""WITH l AS (SELECT pos, lower(array_to_string(list_filter(coalesce(keywords, []), lambda z: z IS NOT NULL), '|')) AS low FROM venues), t AS (SELECT pos, list_sort(list_filter([{_SUBJ}], lambda x: x IS NOT NULL))[1:5] AS tags FROM l)
    SELECT pos, CASE WHEN len(tags) = 0 THEN ['other'] ELSE tags END AS tags FROM t""")
def subject_tag_rules(s, d):
    return table(s, d, "venues").select("pos", catalog.subject_tags(F.col("keywords")).alias("tags"))


@query("""WITH k AS (SELECT pos, list_filter(coalesce(keywords, []), lambda x: x IS NOT NULL) AS t FROM venues)
    SELECT pos, CASE len(t) WHEN 0 THEN '' WHEN 1 THEN 'Covers all aspects of ' || t[1] || '.' WHEN 2 THEN 'Focuses on ' || t[1] || ' and ' || t[2] || '.'
    ELSE 'Covers ' || array_to_string(t[1:3], ', ') || CASE WHEN len(t) > 3 THEN ', and related topics including ' || array_to_string(t[4:6], ', ') ELSE '' END || '.' END AS scope FROM k""")
def topic_scope(s, d):
    k = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return table(s, d, "venues").select("pos", catalog.topic_scope(k).alias("scope"))


@query("""SELECT entry_id, regexp_replace(lower(substring(journal_name, 1, 30)), '[^a-z0-9]', '_', 'g') AS made_id, regexp_replace(lower(journal_name), '[^a-z0-9]', '', 'g') AS abbreviation,
    regexp_replace(substring(journal_name, 1, 30), '[^\\p{L}\\p{N} _-]', '_', 'g') AS file_name FROM typed_venues""")
def name_ids(s, d):
    n = F.col("journal_name")
    return table(s, d, "typed_venues").select("entry_id", tx.normal_id(n).alias("made_id"), tx.abbreviation(n).alias("abbreviation"), safe_name(n).alias("file_name"))


_CASCADE = f"""{sql.CAT}, e AS (SELECT lower(trim(journal_name)) AS n, min_by(journal_id, pos) AS j FROM cat GROUP BY ALL), a AS (SELECT regexp_replace(lower(journal_name), '[^a-z0-9]', '', 'g') AS n, min_by(journal_id, pos) AS j FROM cat GROUP BY ALL)"""


@query(f"""WITH {_CASCADE} SELECT entry_id, coalesce(e.j, a.j) AS journal_id, CASE WHEN e.j IS NOT NULL THEN 1 WHEN a.j IS NOT NULL THEN 2 ELSE 3 END AS tier
    FROM typed_venues t LEFT JOIN e ON e.n = lower(trim(t.journal_name)) AND e.n <> '' LEFT JOIN a ON a.n = regexp_replace(lower(t.journal_name), '[^a-z0-9]', '', 'g') AND a.n <> ''""")
def name_cascade_match(s, d):
    return catalog.cascade(table(s, d, "typed_venues"), "entry_id", "journal_name", catalogue(table(s, d, "venues")))


# the longest common subsequence, row by row: a row is folded over the other name's characters
_LCS = """list_reduce(list_prepend(list_transform(range(length(b) + 1), lambda x: 0::BIGINT), list_transform(string_split(a, ''), lambda ch: [unicode(ch)::BIGINT])),
    lambda prev, ch: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(b) + 1), lambda j: [greatest(prev[j + 1], prev[j] + CASE WHEN unicode(b[j]) = ch[1] THEN 1 ELSE 0 END)])),
        lambda acc, x: list_append(acc, greatest(acc[-1], x[1]))))[-1]"""


@query(f"""WITH {sql.CAT}, q AS (SELECT DISTINCT lower(trim(journal_name)) AS a FROM typed_venues WHERE entry_id % 20 = 0), v AS (SELECT lower(trim(journal_name)) AS b, min(pos) AS pos, min_by(journal_id, pos) AS j FROM cat GROUP BY 1),
    p AS (SELECT a, pos, j, 2.0::DOUBLE * {_LCS} / (length(a) + length(b)) AS alike, len(list_filter({sql.toks('b')}, lambda w: contains(a, w))) > 0 AS worded FROM q, v WHERE a <> '' AND b <> ''),
    s AS (SELECT a, pos, j, CASE WHEN worded THEN greatest(alike, 0.7::DOUBLE) ELSE alike END AS ratio FROM p),
    m AS (SELECT * FROM s WHERE ratio >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY ratio DESC, pos) = 1)
    SELECT entry_id, j AS journal_id, round(ratio, 6) AS ratio FROM typed_venues t JOIN m ON m.a = lower(trim(t.journal_name)) WHERE entry_id % 20 = 0""")
def fuzzy_venue_match(s, d):
    """The best venue of each typed name of the stated query set (``entry_id`` divides by 20), among all venues."""
    return catalog.fuzzy_matches(table(s, d, "typed_venues").where("entry_id % 20 = 0"), "entry_id", "journal_name", catalogue(table(s, d, "venues")))


@query(f"""WITH {_CASCADE}, m AS (SELECT l.listing_id, l.journal_name AS want, c.journal_name AS got FROM listings l JOIN a ON a.n = regexp_replace(lower(l.journal_name), '[^a-z0-9]', '', 'g') JOIN cat c ON c.journal_id = a.j),
    w AS (SELECT listing_id, got, list_filter(list_distinct({sql.toks('want')}), lambda x: length(x) > 2) AS ws FROM m)
    SELECT listing_id, len(ws) > 0 AND len(list_filter(ws, lambda x: contains(lower(got), x))) >= 0.6 * len(ws) AS verified FROM w""")
def venue_keyword_verify(s, d):
    v = catalogue(table(s, d, "venues"))
    one = v.groupBy(tx.abbreviation(F.col("journal_name")).alias("n")).agg(F.min_by("journal_name", "pos").alias("got"))
    want = table(s, d, "listings").select("listing_id", F.col("journal_name").alias("want"), tx.abbreviation(F.col("journal_name")).alias("n"))
    return want.join(one, "n").select("listing_id", catalog.keyword_verified(F.col("want"), F.col("got")).alias("verified"))


_HEAD = " OR ".join(f"starts_with(trim(text), '{h}')" for h in document.HEADINGS)
_BLOCK = f"""lv AS (SELECT *, CASE WHEN ({_HEAD}) AND font_size >= 16 THEN 1 WHEN ({_HEAD}) AND font_size >= 13 THEN 2 WHEN ({_HEAD}) AND font_size >= 11 THEN 3
        WHEN regexp_matches(trim(text), '^\\d+\\.\\s+[A-Z]') THEN 2 WHEN font_size >= 16 AND length(trim(text)) < 100 THEN 1 ELSE 0 END AS level FROM blocks WHERE paper_id IS NOT NULL),
    sn AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY page, y0, x0, block_id) AS section_no FROM lv)"""


@query(f"WITH {_BLOCK} SELECT block_id, level FROM lv")
def heading_detect(s, d):
    return table(s, d, "blocks").where("paper_id is not null").select("block_id", document.heading_level(F.col("text"), F.col("font_size")).alias("level"))


@query(f"""WITH {_BLOCK} SELECT paper_id, section_no::BIGINT AS section_no, coalesce(max(CASE WHEN level > 0 THEN trim(text) END), 'Preamble') AS title, greatest(max(level), 1) AS level, count(*) AS n_blocks,
    coalesce(string_agg(trim(text), ' ' ORDER BY page, y0, x0, block_id) FILTER (WHERE level = 0), '') AS content FROM sn GROUP BY paper_id, section_no""")
def section_assembly(s, d):
    return document.sections(table(s, d, "blocks"))


@query(f"""WITH {_BLOCK}, se AS (SELECT paper_id, section_no, coalesce(max(CASE WHEN level > 0 THEN trim(text) END), 'Preamble') AS title, greatest(max(level), 1) AS level,
        coalesce(string_agg(trim(text), ' ' ORDER BY page, y0, x0, block_id) FILTER (WHERE level = 0), '') AS content FROM sn GROUP BY paper_id, section_no),
    bd AS (SELECT paper_id, string_agg(repeat('#', least(level + 1, 6)::INT) || ' ' || title || chr(10) || content, chr(10) ORDER BY section_no) AS body FROM se GROUP BY paper_id)
    SELECT paper_id, concat_ws(chr(10), '# ' || title, CASE WHEN coalesce(abstract, '') <> '' THEN '## Abstract' || chr(10) || abstract END, body) AS markdown FROM bd JOIN papers USING (paper_id)""")
def paper_markdown(s, d):
    return document.markdown(document.sections(table(s, d, "blocks")), table(s, d, "papers"))


_SECT = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in document.SECTIONS) + " END"


@query(f"""WITH l AS (SELECT paper_id, string_split(full_text, chr(10)) AS ls FROM papers), u AS (SELECT paper_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM l),
    t AS (SELECT paper_id, no, regexp_replace(raw, '^[\\s\\x0b\\p{{Z}}]+|[\\s\\x0b\\p{{Z}}]+$', '', 'g') AS line FROM u),
    f AS (SELECT paper_id, no, line, coalesce(last_value({_SECT} IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY no ROWS UNBOUNDED PRECEDING), 'other') AS section FROM t WHERE line <> '')
    SELECT paper_id, section, string_agg(line, ' ' ORDER BY no) AS content FROM f WHERE length(line) >= 10 AND NOT regexp_matches(line, '^\\d+\\s+\\d+$') GROUP BY ALL""")
def section_split(s, d):
    return document.text_sections(table(s, d, "papers"))


_LOG = """nw AS (SELECT paper_id, max(run_no) AS run_no FROM venue_matches GROUP BY paper_id),
    lg AS (SELECT paper_id, journal_id, row_number() OVER (PARTITION BY paper_id ORDER BY min(match_rank), journal_id) AS rank FROM venue_matches JOIN nw USING (paper_id, run_no) GROUP BY paper_id, journal_id)"""
_HITS = f"""{sql.CAT}, {_LOG}, want AS (SELECT DISTINCT paper_id, lower(trim(journal_name)) AS want FROM typed_venues WHERE paper_id IS NOT NULL AND journal_name IS NOT NULL),
    nm AS (SELECT paper_id, rank, lower(journal_name) AS want FROM lg JOIN cat USING (journal_id)), sz AS (SELECT paper_id, max(rank) AS n FROM lg GROUP BY paper_id),
    h AS (SELECT w.paper_id, w.want, coalesce(any_value(n), 0) AS n, min(nm.rank) AS hit_rank FROM want w LEFT JOIN nm ON nm.paper_id = w.paper_id AND nm.want = w.want LEFT JOIN sz ON sz.paper_id = w.paper_id GROUP BY w.paper_id, w.want)"""
_AGG = ", ".join(f"count_if(coalesce(hit_rank <= {k}, false){f' AND n >= {k}' if k in (3, 5) else ''}) AS hit{k}" for k in (1, 3, 5, 10))
_RATES = ", ".join(f"round(coalesce(hit{k} / nullif(total, 0), 0), 6) AS rate{k}" for k in (1, 3, 5, 10))


def _logged(s, d):
    return evaluate.logged(table(s, d, "venue_matches")).join(catalogue(table(s, d, "venues")).select("journal_id", "journal_name", "subject_tags", "ccf_rating"), "journal_id", "left")


def _hits(s, d):
    return evaluate.hits(_logged(s, d), table(s, d, "typed_venues").select("paper_id", F.col("journal_name").alias("venue")))


@query(f"WITH {_HITS} SELECT paper_id, want, n, hit_rank FROM h")
def coarse_hits(s, d):
    return _hits(s, d)


@query(f"WITH {_HITS}, a AS (SELECT count(*) AS total, {_AGG} FROM h) SELECT *, {_RATES} FROM a")
def hit_at_k(s, d):
    return evaluate.summary(_hits(s, d))


@query(f"""WITH {_HITS}, {sql.PROF}, a AS (SELECT coalesce(research_area[1], '?') AS area, count(*) AS total, {_AGG} FROM h JOIN prof USING (paper_id) GROUP BY ALL) SELECT *, {_RATES} FROM a""")
def hits_by_area(s, d):
    area = current_profiles(table(s, d, "profiles")).select("paper_id", F.coalesce(F.get("research_area", F.lit(0)), F.lit("?")).alias("area"))
    return evaluate.summary(_hits(s, d).join(area, "paper_id"), ["area"])


@query(f"""WITH {_HITS}, {sql.PROF}, a AS (SELECT coalesce(quality_level, '?') AS level, count(*) AS total, {_AGG} FROM h JOIN prof USING (paper_id) GROUP BY ALL) SELECT *, {_RATES} FROM a""")
def hits_by_level(s, d):
    level = current_profiles(table(s, d, "profiles")).select("paper_id", F.coalesce("quality_level", F.lit("?")).alias("level"))
    return evaluate.summary(_hits(s, d).join(level, "paper_id"), ["level"])


@query(f"""WITH {_HITS} SELECT c.unnest::INT AS coarse_k, f.unnest::INT AS final_k, (SELECT count(*) FROM h WHERE hit_rank <= c.unnest AND hit_rank <= f.unnest) AS hits
    FROM unnest([10, 20, 50]) c CROSS JOIN unnest([1, 3, 5, 10]) f""")
def candidate_k_sweep(s, d):
    return evaluate.sweep(_hits(s, d), [10, 20, 50], [1, 3, 5, 10])


@query(f"""WITH {sql.CAT}, {sql.PROF}, {_LOG}, b AS (SELECT CASE WHEN paper_strength IS NULL THEN 'unknown' WHEN paper_strength >= 0.65 THEN 'strong' WHEN paper_strength >= 0.5 THEN 'medium' ELSE 'weak' END AS band, ccf_rating AS r
        FROM lg JOIN prof USING (paper_id) LEFT JOIN cat USING (journal_id) WHERE rank <= 5)
    SELECT band, count(*) AS total, count_if(coalesce((band = 'strong' AND r IN ('A', 'B')) OR (band = 'medium' AND r IN ('B', 'C')) OR (band = 'weak' AND (r IS NULL OR r IN ('C', 'N/A'))), false)) AS matched FROM b GROUP BY band""")
def level_match(s, d):
    band = current_profiles(table(s, d, "profiles")).select("paper_id", rules.strength_band(F.col("paper_strength")).alias("band"))
    j = _logged(s, d).where("rank <= 5").join(band, "paper_id")
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(rules.level_matches(F.col("band"), F.col("ccf_rating")), F.lit(False))).alias("matched"))


@query(f"""WITH {sql.CAT}, {sql.PROF}, {_LOG} SELECT p.paper_id, coalesce(bool_or(len(list_intersect(coalesce(research_area, []), coalesce(subject_tags, []))) > 0), false) AS area_match
    FROM prof p JOIN lg USING (paper_id) LEFT JOIN cat USING (journal_id) GROUP BY p.paper_id""")
def area_match(s, d):
    none = F.array().cast("array<string>")
    area = current_profiles(table(s, d, "profiles")).select("paper_id", F.coalesce("research_area", none).alias("areas"))
    return _logged(s, d).join(area, "paper_id").groupBy("paper_id").agg(F.max(F.arrays_overlap("areas", F.coalesce("subject_tags", none))).alias("area_match"))


@query(f"""WITH {sql.CAT} SELECT tag AS area, coalesce(ccf_rating, '?') AS level, count(*) AS venues FROM (SELECT journal_id, ccf_rating, unnest(list_distinct(subject_tags)) AS tag FROM cat)
    WHERE tag IS NOT NULL AND tag <> '' GROUP BY ALL""")
def venues_by_area_level(s, d):
    """How many venues each area has on each level; ``venue_area_members`` has the members."""
    e = catalogue(table(s, d, "venues")).select("journal_id", "ccf_rating", F.explode(F.array_distinct("subject_tags")).alias("area")).where("area <> ''")
    return e.groupBy("area", F.coalesce("ccf_rating", F.lit("?")).alias("level")).agg(F.count(F.lit(1)).alias("venues"))


@query(f"""WITH {sql.CAT} SELECT area, level, journal_id FROM (SELECT area, level, journal_id, row_number() OVER (PARTITION BY area, level ORDER BY pos) AS r FROM
    (SELECT journal_id, pos, coalesce(ccf_rating, '?') AS level, coalesce(subject_tags[1], '') AS area FROM cat)) WHERE r <= 2""")
def quota_per_area_level(s, d):
    from pyspark.sql import Window

    v = catalogue(table(s, d, "venues")).select("journal_id", "pos", F.coalesce("ccf_rating", F.lit("?")).alias("level"), F.coalesce(F.get("subject_tags", F.lit(0)), F.lit("")).alias("area"))
    return v.withColumn("r", F.row_number().over(Window.partitionBy("area", "level").orderBy("pos"))).where("r <= 2").select("area", "level", "journal_id")


@query(f"""WITH {_LOG}, r AS (SELECT paper_id, rank FROM lg WHERE rank <= 5), n AS (SELECT paper_id, count(*) AS n FROM r GROUP BY paper_id),
    st AS (SELECT unnest([{", ".join(f"{{'seq': {i}, 'stage': '{a}', 'percent': {p}}}" for i, (a, p) in enumerate(events.STAGES))}]) AS e)
    SELECT paper_id, (e.seq)::INT AS seq, 'progress' AS event, e.stage AS stage, (e.percent)::INT AS percent FROM n CROSS JOIN st
    UNION ALL SELECT paper_id, (10 + 2 * (rank - 1))::INT, 'recommendation', 'building', NULL FROM r
    UNION ALL SELECT paper_id, (11 + 2 * (rank - 1))::INT, 'progress', 'building', (85 + ((rank - 1) * 10) // n)::INT FROM r JOIN n USING (paper_id)
    UNION ALL SELECT paper_id, (10 + 2 * n)::INT, 'done', 'done', 100 FROM n""")
def progress_events(s, d):
    return events.progress(evaluate.logged(table(s, d, "venue_matches")).where("rank <= 5"))


@query("""SELECT line_id, json_extract_string(record, '$.journal_id') AS journal_id, json_extract_string(record, '$.journal_name') AS journal_name FROM venue_lines WHERE json_valid(record)""")
def parse_venue_lines(s, d):
    """Raw catalogue lines projected to columns; lines that are no JSON are left out."""
    r = F.from_json("record", "journal_id string, journal_name string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return table(s, d, "venue_lines").select("line_id", r.alias("r")).where("r._corrupt_record is null").select("line_id", "r.journal_id", "r.journal_name")


@query("SELECT line_id, json_extract_string(record, '$.journal_id') AS journal_id FROM venue_lines")
def llm_json_parse(s, d):
    """JSON found in answers of several forms, made from the raw catalogue lines."""
    from .providers import parsed_answers

    raw = F.col("record")
    form = F.when(F.col("line_id") % 3 == 0, raw).when(F.col("line_id") % 3 == 1, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(F.concat(F.lit("The answer is "), raw, F.lit(" as asked.")))
    return parsed_answers(table(s, d, "venue_lines").select("line_id", form.alias("answer")), "answer").select("line_id", F.get_json_object("json", "$.journal_id").alias("journal_id"))


@query(f"""WITH {sql.CAT}, {_LOG}, sc AS (SELECT paper_id, journal_id, max(score) AS score, max(match_reasons) AS reasons FROM venue_matches GROUP BY ALL),
    r AS (SELECT lg.paper_id, rank, journal_name, score, reasons FROM lg JOIN cat USING (journal_id) JOIN sc USING (paper_id, journal_id) WHERE rank <= 5 AND journal_name IS NOT NULL)
    SELECT paper_id, 0 AS no, 'Paper: ' || coalesce(title, '') AS line FROM papers
    UNION ALL SELECT paper_id, (rank * 100)::INT, rank::VARCHAR || '. ' || journal_name || ' (' || printf('%.2f', score) || ')' FROM r
    UNION ALL SELECT paper_id, (rank * 100 + 1 + i)::INT, '  - ' || x FROM (SELECT paper_id, rank, unnest(reasons[1:10]) AS x, generate_subscripts(reasons[1:10], 1) - 1 AS i FROM r)""")
def report_lines(s, d):
    """A printed report of the logged recommendations."""
    r = _logged(s, d).where("rank <= 5").join(table(s, d, "venue_matches").groupBy("paper_id", "journal_id").agg(F.max("score").alias("score"), F.max("match_reasons").alias("reasons")), ["paper_id", "journal_id"])
    return report(r.where("journal_name is not null"), table(s, d, "papers"))


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
    r AS (SELECT *, coalesce(sum(CASE WHEN contains(t, 'http') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rec FROM l),
    g AS (SELECT doc, rec, string_agg(trim(t), ' ' ORDER BY no) AS line FROM r GROUP BY doc, rec) SELECT doc, rec::BIGINT AS rec, line FROM g WHERE contains(line, 'http')""")
def directory_rows(s, d):
    """Directory rows put together from the lines of texts, each up to an address."""
    lines = table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return files.directory_records(lines).where(F.col("line").contains("http"))
