"""Pieces of SQL that the comparison queries share; written for DuckDB, independently of the DataFrame code."""

CAT = "cat AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY pos DESC) AS rn FROM venues WHERE journal_id IS NOT NULL) WHERE rn = 1)"
PROF = (
    "prof AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC NULLS LAST, profile_id DESC) AS rn "
    "FROM profiles WHERE paper_id IS NOT NULL) WHERE rn = 1)"
)
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def toks(e: str, lower: bool = True) -> str:
    t = f"coalesce({e}, '')"
    t = f"lower({t})" if lower else t
    return f"list_filter(regexp_split_to_array({t}, '{SPACE}'), lambda w: w <> '')"


def join(e: str) -> str:
    """A list's elements with blanks between; null elements are left out, as Spark leaves them out."""
    return f"array_to_string(list_filter(coalesce({e}, []), lambda z: z IS NOT NULL), ' ')"


def overlap(a: str, b: str) -> str:
    """Shared words of over two letters by the larger set."""
    x, y = (f"list_filter(list_distinct({toks(e)}), lambda w: length(w) > 2)" for e in (a, b))
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / greatest(len({x}), len({y})) END"


def profile(v: str = "") -> str:
    v = f"{v}." if v else ""
    parts = f"[coalesce({v}journal_name, ''), coalesce({v}scope_text, ''), {join(v + 'keywords')}, {join(v + 'subject_tags')}]"
    return f"array_to_string(list_filter({parts}, lambda p: p <> ''), ' | ')"


PAIRS = f"""{CAT}, {PROF}, pairs AS (
    SELECT m.paper_id, m.journal_id, p.title, p.abstract, p.research_area, p.keywords, p.techniques, p.datasets, p.evaluation_metrics, p.method_type, p.paper_type,
           p.novelty_type, p.paper_strength, v.pos, v.journal_name, coalesce(v.scope_text, '') AS scope_text, v.keywords AS venue_keywords, v.subject_tags, v.oa_type,
           v.target_paper_type, v.ccf_rating
    FROM (SELECT DISTINCT paper_id, journal_id FROM venue_matches) m JOIN prof p USING (paper_id) JOIN cat v USING (journal_id))"""


def topk(source: str, tie: str, k: str, columns: str = "paper_id, journal_id") -> str:
    return f"SELECT {columns}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k}"


def okapi(qtext: str, where: str = "paper_id % 20 = 0", source: str = "papers") -> str:
    """CTEs ending in okapi(paper_id, journal_id, pos, score): every paper against every venue."""
    return f"""bdoc AS (SELECT journal_id, pos, {toks(profile())} AS t FROM cat),
    bterm AS (SELECT journal_id, term, count(*) AS tf FROM (SELECT journal_id, unnest(t) AS term FROM bdoc) GROUP BY ALL),
    bcorp AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM bdoc),
    bdf AS (SELECT term, count(*) AS df FROM bterm GROUP BY term),
    braw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM bdf, bcorp),
    bidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM braw) ELSE raw END AS idf FROM braw),
    bq AS (SELECT paper_id, term, count(*) AS qn FROM (SELECT paper_id, unnest({toks(qtext)}) AS term FROM {source} WHERE {where}) GROUP BY ALL),
    bhit AS (SELECT q.paper_id, b.journal_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.t) / avgdl))) AS s
             FROM bq q JOIN bterm b USING (term) JOIN bidf USING (term) JOIN bdoc d ON d.journal_id = b.journal_id, bcorp GROUP BY ALL),
    okapi AS (SELECT p.paper_id, d.journal_id, d.pos, round(coalesce(s, 0), 6) AS score
              FROM (SELECT paper_id FROM {source} WHERE {where}) p CROSS JOIN bdoc d LEFT JOIN bhit h ON h.paper_id = p.paper_id AND h.journal_id = d.journal_id)"""


ABSTRACT = "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))"
SEARCH = f"concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), {join('keywords')}, {join('research_area')}, {join('techniques')})"
RICH = (
    f"concat_ws(' ', {ABSTRACT}, {ABSTRACT}, {join('keywords')}, {join('techniques')}, {join('application_domain')}, {join('keywords')}, {join('techniques')}, "
    f"{join('datasets')}, {join('evaluation_metrics')}, coalesce(novelty, ''))"
)
