"""Queries of retrieval and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, evaluate, retrieve
from ..operators.tables import asked, catalogue, current_profiles, embedding_text, query_text, rich_query, search_query, venue_profile
from ..session import table
from . import sql

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return wrap


def _docs(s, d):
    return catalogue(table(s, d, "venues")).withColumn("_profile", venue_profile())


@query(f"WITH {sql.CAT} SELECT journal_id, {sql.profile()} AS profile FROM cat")
def venue_profiles(s, d):
    return _docs(s, d).select("journal_id", F.col("_profile").alias("profile"))


@query(f"SELECT doc_id, len({sql.toks('text')}) AS n_tokens, len(list_distinct({sql.toks('text')})) AS n_distinct FROM documents")
def tokenize_stats(s, d):
    t = tx.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""WITH {sql.CAT}, {sql.okapi(sql.ABSTRACT)} SELECT d.term, d.df, round(i.idf, 6) AS idf FROM bdf d JOIN bidf i USING (term)""")
def bm25_index_terms(s, d):
    _, terms, _ = bm25.index(_docs(s, d), "journal_id", F.col("_profile"))
    return terms.select("term", "df", F.round("idf_okapi", 6).alias("idf"))


@query(f"WITH {sql.CAT}, {sql.okapi(sql.ABSTRACT)} {sql.topk('okapi', 'pos', '10')}")
def bm25_topk(s, d):
    """The flagship: the ten best venues of each paper of the query set, by title and abstract."""
    return bm25.okapi_topk(asked(table(s, d, "papers")), "paper_id", query_text(), _docs(s, d), "journal_id", "pos", F.col("_profile"), 10)


_TEXT = f"""tq AS (SELECT paper_id, list_distinct({sql.toks(sql.SEARCH)}) AS q FROM prof WHERE paper_id % 20 = 0),
    td AS (SELECT journal_id, pos, list_distinct({sql.toks(sql.profile())}) AS t FROM cat),
    thit AS (SELECT paper_id, journal_id, pos, round(len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1), 6) AS score FROM tq CROSS JOIN td WHERE len(list_intersect(q, t)) > 0)"""


@query(f"WITH {sql.CAT}, {sql.PROF}, {_TEXT} {sql.topk('thit', 'pos', '14')}")
def text_search_topk(s, d):
    return retrieve.overlap_topk(asked(current_profiles(table(s, d, "profiles"))), "paper_id", search_query(), _docs(s, d), "journal_id", "pos", F.col("_profile"), 14)


_L2 = """v AS (SELECT q.vec_id AS query_id, q.label AS ql, c.vec_id, c.label AS cl,
        -round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS score
        FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v)"""


def _near(s, d):
    e = table(s, d, "embeddings")
    return e, retrieve.vector_topk(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), "query_id", e, "vec_id", "embedding", 10)


@query(f"WITH {_L2} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def vector_topk_l2(s, d):
    return _near(s, d)[1]


@query(f"WITH {_L2} SELECT query_id, max(CASE WHEN rank BETWEEN 2 AND 5 AND ql = cl THEN 1 ELSE 0 END) AS hit5, max(CASE WHEN rank BETWEEN 2 AND 10 AND ql = cl THEN 1 ELSE 0 END) AS hit10 FROM r WHERE rank <= 10 GROUP BY query_id")
def vector_hit_at_k(s, d):
    e, near = _near(s, d)
    lab = e.select("vec_id", "label")
    j = near.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    same = F.col("label") == F.col("ql")
    return j.groupBy("query_id").agg(
        F.max(F.when(same & F.col("rank").between(2, 5), 1).otherwise(0)).alias("hit5"), F.max(F.when(same & F.col("rank").between(2, 10), 1).otherwise(0)).alias("hit10")
    )


def _minmax(equal: str) -> str:
    return f"""WITH {sql.CAT}, {sql.PROF}, {_TEXT}, t AS ({sql.topk('thit', 'pos', '14')})
    SELECT paper_id, journal_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN {equal} ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm
    FROM t WINDOW w AS (PARTITION BY paper_id)"""


@query(_minmax("0.0"))
def minmax_zero(s, d):
    return text_search_topk(s, d).select("paper_id", "journal_id", F.round(retrieve.min_max(["paper_id"], 0.0), 6).alias("norm"))


@query(_minmax("0.5"))
def minmax_half(s, d):
    return text_search_topk(s, d).select("paper_id", "journal_id", F.round(retrieve.min_max(["paper_id"], 0.5), 6).alias("norm"))


@query(f"WITH {sql.PROF} SELECT paper_id, term, count(*) AS qn FROM (SELECT paper_id, unnest({sql.toks(sql.RICH)}) AS term FROM prof) GROUP BY ALL")
def rich_query_terms(s, d):
    return bm25.query_terms(current_profiles(table(s, d, "profiles")), "paper_id", rich_query())


_SIZE = "CASE mode WHEN 'title' THEN {0} WHEN 'full' THEN {1} ELSE {2} END"


#: CTEs after ``cat`` and ``prof``, ending in fused(paper_id, journal_id, score, met): the lexical routes of the query set, and of all papers
FUSED = f"""asked AS (SELECT p.*, m.mode FROM prof p JOIN (SELECT paper_id, mode FROM papers) m USING (paper_id) WHERE p.paper_id % 20 = 0),
    {sql.okapi(sql.RICH, source="asked")}, {_TEXT.replace("FROM prof", "FROM asked")},
    br AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS rank FROM okapi),
    tr AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS rank FROM thit),
    routes AS (SELECT paper_id, journal_id, score, rank AS met, 0.45 AS weight, 0 AS route FROM br JOIN asked USING (paper_id) WHERE rank <= {_SIZE.format(22, 32, 28)}
        UNION ALL SELECT paper_id, journal_id, score, 2000 + rank, 0.20, 2 FROM tr JOIN asked USING (paper_id) WHERE rank <= {_SIZE.format(16, 16, 14)}),
    norm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END * weight AS n
        FROM routes WINDOW w AS (PARTITION BY paper_id, route)),
    fused AS (SELECT paper_id, journal_id, round(sum(n), 6) AS score, min(met) AS met FROM norm GROUP BY ALL)"""  # fmt: skip
FUSED_ALL = FUSED.replace(" WHERE p.paper_id % 20 = 0", "").replace(" WHERE paper_id % 20 = 0", "")


@query(f"WITH {sql.CAT}, {sql.PROF}, {FUSED_ALL} {sql.topk('fused', 'met', '50')}")
def hybrid_fusion_by_mode(s, d):
    """The lexical routes of every paper fused, with the fan-out of its mode; no vector route without an index."""
    from .pipeline import candidates

    mode = table(s, d, "papers").select("paper_id", "mode")
    return candidates(current_profiles(table(s, d, "profiles")).join(mode, "paper_id"), table(s, d, "venues"))


@query()
def hybrid_fusion_three_routes(s, d):
    """All three routes of every paper: the vectors are hashed words, so the same in every run; the exact search is tested against brute force."""
    from .pipeline import candidates
    from .providers import HashingEmbedding

    mode = table(s, d, "papers").select("paper_id", "mode")
    return candidates(current_profiles(table(s, d, "profiles")).join(mode, "paper_id"), table(s, d, "venues"), HashingEmbedding())


@query(f"WITH {sql.CAT} SELECT journal_id, {sql.profile()} AS profile_text, coalesce(journal_name, '') || '. ' || coalesce(scope_text, '') AS name_text FROM cat")
def embedding_texts(s, d):
    return _docs(s, d).select("journal_id", F.col("_profile").alias("profile_text"), embedding_text().alias("name_text"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '" + sql.SPACE + r"', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g')) AS cleaned FROM documents".replace(r"\x00-\x1f\x7f-\x9f", r"\x{00}-\x{1f}\x{7f}-\x{9f}"))
def clean_text_plain(s, d):
    return table(s, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, trim(substring(regexp_replace(regexp_replace(text, '" + sql.SPACE + r"', ' ', 'g'), '[^一-龥a-zA-Z0-9\s.,;:!?()\[\]（）【】]', '', 'g'), 1, 50000)) AS cleaned FROM documents")
def clean_text_file(s, d):
    return table(s, d, "documents").select("doc_id", tx.clean_file_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '...' ELSE text END AS cut FROM documents")
def truncate_text(s, d):
    return table(s, d, "documents").select("doc_id", tx.truncate(F.col("text")).alias("cut"))


@query(f"""SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？\\n]+'), lambda x: regexp_replace(x, '^{sql.SPACE}|{sql.SPACE}$', '', 'g')), lambda x: x <> ''), lambda x: x) AS parts FROM documents""")
def split_sentences(s, d):
    return table(s, d, "documents").select("doc_id", tx.rough_sentences(F.col("text")).alias("parts"))


@query("""SELECT doc_id, e AS estimate, greatest(1500, least(8192, 200000 - e)) AS budget FROM (SELECT doc_id,
    length(regexp_replace(coalesce(text, ''), '[^一-龥]', '', 'g')) + (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^一-龥]', '', 'g'))) // 4 AS e FROM documents)""")
def token_budget(s, d):
    e = tx.token_estimate(F.col("text"))
    return table(s, d, "documents").select("doc_id", e.alias("estimate"), tx.output_budget(e).alias("budget"))


@query(r"""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+') AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
    c AS (SELECT doc_id, word, count(*) AS n, min(place) AS place FROM u WHERE regexp_matches(word, '^[a-z]{4,}$') GROUP BY ALL)
    SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS rank FROM c) WHERE rank <= 5""")
def keyword_topk(s, d):
    return evaluate.keyword_topk(table(s, d, "documents"), "doc_id", "text")
