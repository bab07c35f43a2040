"""Queries of the rule features and of what builds on them, over the pairs of the recommendation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, rules
from ..operators.tables import arr, catalogue, current_profiles, logged_pairs
from ..session import table
from . import sql

QUERIES, SQL = {}, {}


def _pairs(s, d):
    return logged_pairs(table(s, d, "venue_matches"), table(s, d, "profiles"), table(s, d, "venues"))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _groups(groups) -> str:
    return "[" + ", ".join(_list(g) for g in groups) + "]"


_TITLE = f"list_filter(list_distinct({sql.toks('title')}), lambda w: length(w) > 1 AND NOT list_contains({_list(rules.STOP)}, w))"
_NAME = f"list_filter(list_distinct({sql.toks('journal_name')}), lambda w: length(w) > 1 AND NOT list_contains({_list(rules.STOP)}, w))"
_NAME2 = f"list_filter(list_distinct({sql.toks('journal_name')}), lambda w: length(w) > 1 AND NOT list_contains({_list(rules.STOP_NAME)}, w))"
_PAPER = f"concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), {sql.join('keywords')}, {sql.join('techniques')})"
_VENUE = f"concat_ws(' ', scope_text, {sql.join('venue_keywords')}, coalesce(journal_name, ''))"


def _named(column: str, groups) -> str:
    some = f"len(list_filter({_groups(groups)}, lambda g: len(list_filter(g, lambda a: contains(lower(x), a))) > 0 AND len(list_filter(g, lambda a: contains(lower(scope_text), a))) > 0)) > 0"
    return f"len(list_filter(list_filter(coalesce({column}, []), lambda x: x IS NOT NULL), lambda x: contains(lower(scope_text), lower(x)) OR {some})) > 0"


def _above(e: str, least: float, factor: float = 1.0) -> str:
    return f"CASE WHEN {e} > {least} THEN ({e}) * {factor} ELSE 0.0 END"


FEATURES = {
    "title_journal_name": f"CASE WHEN len(list_intersect({_TITLE}, {_NAME})) > 0 THEN 1.0 ELSE 0.0 END",
    "journal_name_keyword": f"CASE WHEN len(list_intersect({_NAME2}, list_transform(list_concat(coalesce(keywords, []), coalesce(techniques, [])), lambda x: lower(x)))) > 0 THEN 1.0 ELSE 0.0 END",
    "technique_match": _above(sql.overlap(sql.join("techniques"), "scope_text"), 0.2),
    "method_type_match": "CASE WHEN list_contains(target_paper_type, method_type) THEN 1.0 ELSE 0.0 END",
    "paper_type_match": "CASE WHEN contains(lower(scope_text), paper_type) THEN 1.0 ELSE 0.0 END",
    "keyword_overlap": _above(sql.overlap(_PAPER, _VENUE), 0.1),
    "dataset_match": f"CASE WHEN {_named('datasets', rules.DATASETS)} THEN 1.0 ELSE {_above(sql.overlap(sql.join('datasets'), 'scope_text'), 0.1, 0.5)} END",
    "metric_match": f"CASE WHEN {_named('evaluation_metrics', rules.METRICS)} THEN 1.0 ELSE 0.0 END",
    "novelty_match": "CASE " + " ".join(f"WHEN novelty_type = '{k}' AND len(list_filter({_list(ws)}, lambda a: contains(lower(scope_text), a))) > 0 THEN 1.0" for k, ws in rules.NOVELTY.items()) + " ELSE 0.0 END",
}


def _feature_query(name, column):
    def run(s, d):
        return _pairs(s, d).select("paper_id", "journal_id", F.round(F.coalesce(column(), F.lit(0.0)), 6).alias("value"))

    run.__name__ = f"rule_{name.removesuffix('_match')}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"WITH {sql.PAIRS} SELECT paper_id, journal_id, round(({FEATURES[name]})::DOUBLE, 6) AS value FROM pairs"


for _name, _column in rules.FEATURES.items():
    _feature_query(_name, _column)


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return wrap


@query(f"WITH {sql.PAIRS} SELECT paper_id, journal_id, list_sort(list_distinct(list_filter(coalesce(research_area, []), lambda a: list_contains(coalesce(subject_tags, []), a)))) AS areas FROM pairs")
def rule_area(s, d):
    return _pairs(s, d).select("paper_id", "journal_id", rules.research_area_match().alias("areas"))


@query(f"WITH {sql.PAIRS} SELECT paper_id, journal_id, CASE WHEN oa_type IN ('full_oa', 'hybrid') THEN 1.0 WHEN oa_type IS NULL THEN NULL ELSE 0.0 END::DOUBLE AS value FROM pairs")
def rule_oa(s, d):
    return _pairs(s, d).select("paper_id", "journal_id", rules.oa_preference_match("hybrid").alias("value"))


_PLUS = f"""{sql.PAIRS},
    pd AS (SELECT journal_id, {sql.toks("scope_text", False)} AS t FROM cat),
    pt AS (SELECT journal_id, term, count(*) AS tf FROM (SELECT journal_id, unnest(t) AS term FROM pd) GROUP BY ALL),
    pc AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM pd),
    pidf AS (SELECT term, ln((n + 1) / count(*)) AS idf FROM pt, pc GROUP BY term, n),
    pg AS (SELECT journal_id, term, idf * tf * 2.5 / (1.5 * (0.25 + 0.75 * len(t) / avgdl) + tf) AS gain FROM pt JOIN pd USING (journal_id) JOIN pidf USING (term), pc),
    fq AS (SELECT term, count(*) AS qn FROM (SELECT unnest(string_split('{rules.BM25_SCALE}', ' ')) AS term) GROUP BY term),
    fs AS (SELECT d.journal_id, sum(qn * (idf + coalesce(gain, 0))) AS s FROM pd d CROSS JOIN fq JOIN pidf USING (term) LEFT JOIN pg ON pg.journal_id = d.journal_id AND pg.term = fq.term GROUP BY d.journal_id),
    fm AS (SELECT CASE WHEN coalesce(max(s), 0) > 0 THEN max(s) ELSE 1.0 END AS m FROM fs),
    qq AS (SELECT paper_id, term, count(*) AS qn FROM (SELECT paper_id, unnest({sql.toks("concat_ws(' ', coalesce(title, ''), " + sql.join("keywords") + ")", False)}) AS term FROM prof) GROUP BY ALL),
    ps AS (SELECT p.paper_id, p.journal_id, round(coalesce(sum(qn * (idf + coalesce(gain, 0))), 0) / any_value(m), 6) AS score
        FROM pairs p CROSS JOIN fm LEFT JOIN (qq JOIN pidf USING (term)) q ON q.paper_id = p.paper_id LEFT JOIN pg ON pg.journal_id = p.journal_id AND pg.term = q.term GROUP BY ALL)"""


def _plus(s, d):
    p = _pairs(s, d).withColumn("_t", F.concat_ws(" ", F.coalesce("title", F.lit("")), tx.joined(arr("keywords"))))
    return bm25.plus_scores(p, "paper_id", F.col("_t"), catalogue(table(s, d, "venues")), "journal_id", F.coalesce("scope_text", F.lit("")), rules.BM25_SCALE)


@query(f"WITH {_PLUS} SELECT paper_id, journal_id, score FROM ps")
def bm25_plus_scope(s, d):
    return _plus(s, d)


_TERMS = " + ".join(f"{rules.WEIGHTS[n]} * ({e})" for n, e in FEATURES.items())
_SCORED = f"{_PLUS}, scored AS (SELECT p.*, round({_TERMS} + CASE WHEN s.score > 0.1 THEN 3.0 * s.score ELSE 0.0 END, 6) AS score FROM pairs p JOIN ps s USING (paper_id, journal_id))"
_RANKED = f"{_SCORED}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS rule_rank FROM scored) WHERE rule_rank <= 20)"
_FACTOR = "greatest(0.8, least(1.08, 0.9 + 0.2 * (paper_strength - 0.5))) * CASE ccf_rating WHEN 'A' THEN 1.05 WHEN 'B' THEN 1.02 ELSE 1.0 END"
_ADJ = f"{_RANKED}, adj AS (SELECT *, round(score * CASE WHEN paper_strength IS NULL THEN 1.0 ELSE {_FACTOR} END, 6) AS adjusted FROM ranked)"


def _ranked(s, d):
    p = _pairs(s, d).join(_plus(s, d).select("paper_id", "journal_id", F.col("score").alias("bm25")), ["paper_id", "journal_id"])
    return rules.ranked(rules.scored(p), 20)


@query(f"WITH {_RANKED} SELECT paper_id, journal_id, score, rule_rank FROM ranked")
def rule_rank_top20(s, d):
    return _ranked(s, d).select("paper_id", "journal_id", "score", "rule_rank")


@query(f"WITH {_ADJ} SELECT paper_id, journal_id, adjusted, row_number() OVER (PARTITION BY paper_id ORDER BY adjusted DESC, rule_rank) AS rank FROM adj")
def quality_adjusted_rank(s, d):
    return rules.adjusted(_ranked(s, d)).select("paper_id", "journal_id", "adjusted", "rank")


@query(f"""WITH {_RANKED}, newest AS (SELECT paper_id, max(run_no) AS run_no FROM venue_matches GROUP BY paper_id),
    ans AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY m.paper_id, m.journal_id ORDER BY match_rank DESC, match_id DESC) AS r FROM venue_matches m JOIN newest USING (paper_id, run_no)) WHERE r = 1),
    both_ AS (SELECT k.paper_id, k.journal_id, k.rule_rank, coalesce(a.score, k.score) AS score, coalesce(a.confidence, 0.5) AS confidence FROM ranked k JOIN ans a USING (paper_id, journal_id))
    SELECT paper_id, journal_id, score, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, rule_rank) AS rank FROM both_) WHERE rank <= 5""")  # fmt: skip
def rerank_merge(s, d):
    """The newest logged run of each paper taken as a re-ranker's answer to the rule ranking."""
    m = table(s, d, "venue_matches")
    newest = m.groupBy("paper_id").agg(F.max("run_no").alias("run_no"))
    # of rows delivered twice and venues named twice, the last stands
    no = F.struct("match_rank", "match_id")
    answers = m.join(newest, ["paper_id", "run_no"]).select("paper_id", "journal_id", no.alias("no"), "score", F.col("match_reasons").alias("reasons"), "confidence")
    out = rules.merged_rerank(_ranked(s, d).withColumn("reasons", rules.reasons()), answers)
    return out.select("paper_id", "journal_id", "score", "confidence", "rank")


@query("SELECT match_id, paper_id, journal_id, round(0.4 * least(score / 10, 1.0) + 0.6 * coalesce(confidence, 0.5), 6) AS combined FROM (SELECT DISTINCT match_id, paper_id, journal_id, score, confidence FROM venue_matches)")
def confidence_combine(s, d):
    m = table(s, d, "venue_matches").select("match_id", "paper_id", "journal_id", "score", "confidence").distinct()
    return m.select("match_id", "paper_id", "journal_id", F.round(rules.confidence(F.col("score"), F.coalesce("confidence", F.lit(0.5))), 6).alias("combined"))


_UP = " + ".join(f"contains(lower(abstract), '{w}')::INT" for w in rules.STRONG)
_DOWN = " + ".join(f"contains(lower(abstract), '{w}')::INT" for w in rules.WEAK)
_STRENGTH = f"CASE WHEN coalesce(abstract, '') = '' THEN 0.4 ELSE greatest(0.2, least(0.9, round(0.5 + 0.1 * (({_UP}) - ({_DOWN})), 6))) END"


@query(f"SELECT paper_id, ({_STRENGTH})::DOUBLE AS strength FROM papers")
def strength_heuristic(s, d):
    return table(s, d, "papers").select("paper_id", rules.strength(F.col("abstract")).alias("strength"))


@query(f"""WITH {sql.PROF} SELECT paper_id, CASE WHEN paper_strength IS NULL THEN 'unknown' WHEN paper_strength >= 0.65 THEN 'strong' WHEN paper_strength >= 0.5 THEN 'medium' ELSE 'weak' END AS band,
    CASE WHEN paper_strength >= 0.65 THEN 'A' WHEN paper_strength >= 0.45 THEN 'B' WHEN paper_strength >= 0.25 THEN 'C' ELSE 'D' END AS level,
    CASE WHEN paper_strength >= 0.6 AND coalesce(quality_confidence, 0) * 3 >= 2 THEN 'Ready' WHEN paper_strength >= 0.35 THEN 'Preliminary' ELSE 'Needs-Revision' END AS ready,
    round(least((0.35 * coalesce(quality_confidence * 3, 1) + 0.25 * coalesce(paper_strength * 3, 1) + 0.15 * coalesce(least(3, len(datasets)), 1) + 0.15 * coalesce(least(3, len(evaluation_metrics)), 1)
        + 0.10 * coalesce(least(3, len(techniques)), 1)) / 3, 1.0), 6) AS assessed FROM prof""")
def quality_bands(s, d):
    p = current_profiles(table(s, d, "profiles"))
    q = F.col("paper_strength")
    upto3 = lambda c: F.when(F.col(c).isNotNull(), F.least(F.lit(3), F.size(c)))
    return p.select(
        "paper_id", rules.strength_band(q).alias("band"), rules.strength_level(q).alias("level"), rules.readiness(q, F.coalesce("quality_confidence", F.lit(0.0)) * 3).alias("ready"),
        F.round(rules.assessed(F.col("quality_confidence") * 3, q * 3, upto3("datasets"), upto3("evaluation_metrics"), upto3("techniques")), 6).alias("assessed"),
    )


_SHARED = "list_sort(list_distinct(list_filter(coalesce(research_area, []), lambda a: list_contains(coalesce(subject_tags, []), a))))"


@query(f"""WITH {sql.PAIRS}, r AS (SELECT paper_id, journal_id, [
    CASE WHEN len(coalesce(research_area, [])) > 0 THEN CASE WHEN len({_SHARED}) > 0 THEN '领域匹配：' || array_to_string({_SHARED}, ', ') ELSE '领域：' || array_to_string(research_area[1:2], ', ') END END,
    CASE WHEN len(coalesce(techniques, [])) > 0 THEN '技术：' || array_to_string(techniques[1:2], ', ') END,
    CASE WHEN coalesce(method_type, '') <> '' THEN '类型：' || CASE method_type WHEN 'method' THEN '方法论' WHEN 'system' THEN '系统设计' WHEN 'experiment' THEN '实验' WHEN 'survey' THEN '综述' ELSE method_type END END,
    CASE WHEN coalesce(oa_type, '') <> '' THEN '出版：' || CASE oa_type WHEN 'full_oa' THEN '完全OA' WHEN 'hybrid' THEN '混合OA' WHEN 'subscription' THEN '订阅' ELSE oa_type END END] AS l FROM pairs)
    SELECT paper_id, journal_id, CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) = 0 THEN ['匹配度较高'] ELSE list_filter(l, lambda x: x IS NOT NULL) END AS reasons FROM r""")
def explain_fallback(s, d):
    """The reasons as they are; shared areas are named in alphabetical order."""
    return _pairs(s, d).select("paper_id", "journal_id", rules.fallback_reasons().alias("reasons"))


def _recommended_sql() -> str:
    """The fused candidates of the query set, scored by the rules and adjusted."""
    from .q_retrieval import FUSED

    cols = "f.paper_id, f.journal_id, p.title, p.abstract, p.research_area, p.keywords, p.techniques, p.datasets, p.evaluation_metrics, p.method_type, p.paper_type, p.novelty_type, p.paper_strength"
    pairs = f"""pairs AS (SELECT {cols}, v.pos, v.journal_name, coalesce(v.scope_text, '') AS scope_text, v.keywords AS venue_keywords, v.subject_tags, v.oa_type, v.target_paper_type, v.ccf_rating
        FROM top50 f JOIN prof p USING (paper_id) JOIN cat v USING (journal_id))"""
    head = f"{sql.CAT}, {sql.PROF.replace('prof AS', 'prof0 AS')}, prof AS (SELECT q.* REPLACE (m.title AS title, m.abstract AS abstract) FROM prof0 q JOIN papers m USING (paper_id))"
    rest = _ADJ.removeprefix(f"{sql.PAIRS},")
    top = "SELECT paper_id, journal_id, adjusted AS score, row_number() OVER (PARTITION BY paper_id ORDER BY adjusted DESC, rule_rank) AS rank FROM adj"
    return f"WITH {head}, {FUSED}, top50 AS ({sql.topk('fused', 'met', '50')}), {pairs}, {rest} SELECT paper_id, rank, journal_id, score, 0.5::DOUBLE AS confidence FROM ({top}) WHERE rank <= 5"


def recommend_rule_only(s, d):
    """The whole pipeline without a model, for the papers of the query set."""
    from .pipeline import recommend

    papers = current_profiles(table(s, d, "profiles")).drop("title", "abstract").join(table(s, d, "papers").select("paper_id", "title", "abstract", "full_text", "mode"), "paper_id").where("paper_id % 20 = 0")
    return recommend(papers, table(s, d, "venues")).select("paper_id", "rank", "journal_id", "score", "confidence")


query(_recommended_sql())(recommend_rule_only)
