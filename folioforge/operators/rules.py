"""Rule features of (profile, venue) pairs, their weighted score, and what adjusts it. All are column expressions.

What a feature needs of a text, its word set or the groups of names that it has, is a column of the paper or of the venue
(``PAPER``, ``VENUE``), made once for each before they are paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .tables import arr

#: fixed values: the weights of the features
WEIGHTS = {
    "bm25_title_scope": 3.0, "title_journal_name": 1.5, "journal_name_keyword": 1.0, "technique_match": 2.0, "keyword_overlap": 1.5,
    "method_type_match": 1.5, "paper_type_match": 1.0, "dataset_match": 1.0, "metric_match": 0.8, "novelty_match": 0.7,
    "oa_preference_match": 0.3, "research_area_match": 0.0,
}
#: fixed values: the query that BM25 scores are measured by
BM25_SCALE = "machine learning deep neural network"
#: fixed values: stop words
STOP = ("the", "a", "an", "of", "and", "in", "on", "for", "to", "with", "by", "from", "is", "as", "at")
STOP_NAME = (*STOP, "journal", "transactions", "ieee", "acm", "international", "proceedings")
#: fixed values: names of one dataset
DATASETS = (
    ("pubmed", "biomedical", "生物医学"), ("imagenet", "image net"), ("coco", "ms coco", "common objects in context"), ("mnist", "digit recognition"),
    ("wikitext", "wikipedia", "wiki"), ("glue", "glue benchmark"), ("squad", "question answering"), ("arxiv", "cs.", "computer science"),
    ("github", "code generation", "program synthesis"), ("freebase", "knowledge graph"), ("dbpedia", "knowledge base"), ("wikidata", "knowledge graph"),
    ("wordnet", "lexical"), ("voc", "pascal voc", "object detection"), ("visual genome", "scene graph"), ("flickr", "image caption"),
    ("sst", "sentiment", "情感分析"), ("snli", "natural language inference", "entailment"), ("multinli", "multi-genre nli"),
    ("llm", "large language model", "language model"), ("rag", "retrieval-augmented", "retrieval augmented"), ("knowledge graph", "knowledge base"),
    ("ner", "named entity recognition", "命名实体"), ("relation extraction", "relex"), ("citation network", "bibliographic", "co-citation"),
)
#: fixed values: names of one metric; "mAP" can match no lower-case text, as in the original list
METRICS = (
    ("accuracy", "acc"), ("f1", "f1-score", "f1 score"), ("map", "mean average precision", "mAP"), ("mrr", "mean reciprocal rank"), ("ndcg", "normalized dcg"),
    ("bleu", "bilingual evaluation understudy"), ("rouge", "recall-oriented understudy"), ("perplexity", "ppl"), ("latency", "inference time", "response time"),
    ("throughput", "tokens per second", "tps"), ("hit rate", "hits@k"), ("auc", "area under curve"), ("recall", "sensitivity"), ("precision",),
    ("em", "exact match"), ("bertscore", "bert score"),
)
#: fixed values: what a scope says of a kind of novelty
NOVELTY = {
    "new_method": ("novel", "new method", "新的方法", "创新方法"), "new_application": ("application", "应用", "场景"), "benchmark": ("benchmark", "基准", "dataset", "数据集"),
    "performance": ("performance", "improvement", "提升", "性能"), "efficiency": ("efficiency", "fast", "efficient", "高效", "加速"),
}
#: fixed values: how a venue's rating counts beside the paper's strength
RATING_FACTOR = {"A": 1.05, "B": 1.02}


def _scope() -> Column:
    return F.coalesce(F.col("scope_text"), F.lit(""))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _words(c: str, stop: tuple[str, ...]) -> Column:
    return F.filter(tx.token_set(F.col(c)), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def _groups(text: Column, groups: tuple) -> Column:
    """The numbers of the groups that have a name in the text."""
    found = [F.when(_any([F.contains(text, F.lit(a)) for a in g]), F.lit(i)) for i, g in enumerate(groups)]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def _group_names(column: str, groups: tuple) -> Column:
    """The groups of which an element of the list has a name."""
    return F.array_distinct(F.flatten(F.transform(F.filter(arr(column), lambda d: d.isNotNull()), lambda d: _groups(F.lower(d), groups))))


def _lowered(column: str) -> Column:
    return F.transform(F.filter(arr(column), lambda d: d.isNotNull()), lambda d: F.lower(d))


def _novelties() -> Column:
    scope = F.lower(_scope())
    return F.filter(F.array(*[F.when(_any([F.contains(scope, F.lit(n)) for n in names]), F.lit(k)) for k, names in NOVELTY.items()]), lambda k: k.isNotNull())


#: what the features need of a paper, and of a venue
PAPER = {
    "_title_words": lambda: _words("title", STOP),
    "_terms": lambda: F.transform(F.concat(arr("keywords"), arr("techniques")), lambda t: F.lower(t)),
    "_technique_words": lambda: tx.long_words(tx.joined(F.col("techniques"))),
    "_dataset_words": lambda: tx.long_words(tx.joined(F.col("datasets"))),
    "_paper_words": lambda: tx.long_words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), tx.joined(F.col("keywords")), tx.joined(F.col("techniques")))),
    "_datasets": lambda: _lowered("datasets"), "_dataset_groups": lambda: _group_names("datasets", DATASETS),
    "_metrics": lambda: _lowered("evaluation_metrics"), "_metric_groups": lambda: _group_names("evaluation_metrics", METRICS),
}
VENUE = {
    "_name_words": lambda: _words("journal_name", STOP), "_own_name_words": lambda: _words("journal_name", STOP_NAME),
    "_scope": lambda: F.lower(_scope()), "_scope_words": lambda: tx.long_words(_scope()),
    "_venue_words": lambda: tx.long_words(F.concat_ws(" ", _scope(), tx.joined(F.col("venue_keywords")), F.coalesce("journal_name", F.lit("")))),
    "_scope_datasets": lambda: _groups(F.lower(_scope()), DATASETS), "_scope_metrics": lambda: _groups(F.lower(_scope()), METRICS), "_scope_novelties": _novelties,
}


def prepared(df: DataFrame, side: dict) -> DataFrame:
    """``df`` with the columns of ``PAPER`` or ``VENUE`` that it lacks."""
    return df.select("*", *[make().alias(name) for name, make in side.items() if name not in df.columns])


def title_journal_name() -> Column:
    return F.arrays_overlap("_title_words", "_name_words").cast("double")


def journal_name_keyword() -> Column:
    return (F.size(F.array_intersect("_own_name_words", "_terms")) > 0).cast("double")


def technique_match() -> Column:
    o = tx.set_overlap(F.col("_technique_words"), F.col("_scope_words"))
    return F.when(o > 0.2, o).otherwise(0.0)


def method_type_match() -> Column:
    return F.coalesce(F.array_contains("target_paper_type", F.col("method_type")), F.lit(False)).cast("double")


def paper_type_match() -> Column:
    return F.coalesce(F.contains("_scope", F.col("paper_type")), F.lit(False)).cast("double")


def keyword_overlap() -> Column:
    o = tx.set_overlap(F.col("_paper_words"), F.col("_venue_words"))
    return F.when(o > 0.1, o).otherwise(0.0)


def _named(names: str, groups: str, scope_groups: str) -> Column:
    """Whether the scope has one of the names, or a name of one of their groups."""
    return F.exists(names, lambda d: F.contains(F.col("_scope"), d)) | F.arrays_overlap(groups, scope_groups)


def dataset_match() -> Column:
    o = tx.set_overlap(F.col("_dataset_words"), F.col("_scope_words"))
    return F.when(_named("_datasets", "_dataset_groups", "_scope_datasets"), 1.0).when(o > 0.1, o * 0.5).otherwise(0.0)


def metric_match() -> Column:
    return _named("_metrics", "_metric_groups", "_scope_metrics").cast("double")


def novelty_match() -> Column:
    return F.coalesce(F.array_contains("_scope_novelties", F.col("novelty_type")), F.lit(False)).cast("double")


def research_area_match() -> Column:
    """The areas that are tags of the venue; they give a reason and no score."""
    return F.array_sort(F.array_intersect(arr("research_area"), arr("subject_tags")))


def oa_preference_match(preference: str = "any") -> Column:
    if preference == "full_oa":
        return (F.col("oa_type") == "full_oa").cast("double")
    if preference == "hybrid":
        return F.col("oa_type").isin("full_oa", "hybrid").cast("double")
    return F.lit(0.0)


FEATURES = {
    f.__name__: f
    for f in (
        title_journal_name, journal_name_keyword, technique_match, method_type_match, paper_type_match, keyword_overlap, dataset_match, metric_match,
        novelty_match,
    )
}


def scored(pairs: DataFrame, preference: str = "any") -> DataFrame:
    """The pairs with every feature and ``score``; a ``bm25`` column, where there is one, counts from 0.1 on."""
    ready = prepared(prepared(pairs, PAPER), VENUE)
    out = ready.select("*", *[F.coalesce(f(), F.lit(0.0)).alias(name) for name, f in FEATURES.items()], F.coalesce(oa_preference_match(preference), F.lit(0.0)).alias("oa_preference_match"))
    terms = [F.col(n) * w for n, w in WEIGHTS.items() if n in out.columns]
    if "bm25" in pairs.columns:
        terms.append(F.when(F.col("bm25") > 0.1, F.col("bm25") * WEIGHTS["bm25_title_scope"]).otherwise(0.0))
    return out.withColumn("score", F.round(reduce(lambda a, b: a + b, terms), 6)).drop(*PAPER, *VENUE)


def reasons() -> Column:
    """The reasons of a scored pair, in the order of the features."""
    found = [
        F.when(F.col("title_journal_name") > 0, F.lit("title shares words with the venue's name")),
        F.when(F.col("journal_name_keyword") > 0, F.lit("the venue's name holds a keyword")),
        F.when(F.col("method_type_match") > 0, F.concat(F.lit("takes papers of kind "), F.col("method_type"))),
        F.when(F.col("keyword_overlap") > 0, F.lit("keywords agree with the scope")),
        F.when(F.col("dataset_match") == 1, F.lit("datasets agree with the scope")),
        F.when(F.col("metric_match") > 0, F.lit("metrics agree with the scope")),
        F.when(F.col("novelty_match") > 0, F.concat(F.lit("novelty agrees: "), F.col("novelty_type"))),
        F.when(F.size(research_area_match()) > 0, F.concat(F.lit("areas agree: "), F.array_join(research_area_match(), ", "))),
        F.when(F.col("oa_preference_match") > 0, F.concat(F.lit("access: "), F.col("oa_type"))),
    ]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def ranked(scored_pairs: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), "pos")
    return scored_pairs.withColumn("rule_rank", F.row_number().over(w)).where(F.col("rule_rank") <= k)


def adjusted(rule_ranked: DataFrame) -> DataFrame:
    """Scores multiplied by the paper's strength and the venue's rating, ranked anew; no strength, no change."""
    rating = F.coalesce(F.when(F.col("ccf_rating") == "A", RATING_FACTOR["A"]).when(F.col("ccf_rating") == "B", RATING_FACTOR["B"]), F.lit(1.0))
    factor = F.when(F.col("paper_strength").isNull(), 1.0).otherwise(tx.quality_factor(F.col("paper_strength")) * rating)
    scored_ = rule_ranked.withColumn("adjusted", F.round(F.col("score") * factor, 6))
    return scored_.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("adjusted"), "rule_rank")))


def confidence(rule: Column, model: Column) -> Column:
    return 0.4 * F.least(rule / 10, F.lit(1.0)) + 0.6 * model


def combined(weights: Column, features: Column) -> Column:
    """The sum over the keys that both maps have."""
    return F.aggregate(F.map_entries(weights), F.lit(0.0), lambda acc, e: acc + F.coalesce(e["value"] * F.try_element_at(features, e["key"]), F.lit(0.0)))


def merged_rerank(rule_ranked: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """Joins a re-ranker's answers (paper_id, no, journal_id, score, reasons, confidence) to the candidates.

    What the answer leaves out is dropped, of repeated venues the last stands, absent values are those of the
    rules, an absent confidence is 0.5.
    """
    last = answers.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id", "journal_id").orderBy(F.desc("no")))).where("_r = 1")
    last = last.select("paper_id", "journal_id", F.col("score").alias("s"), F.col("reasons").alias("why"), F.col("confidence").alias("c"))
    both = rule_ranked.join(last, ["paper_id", "journal_id"]).select(
        "paper_id", "journal_id", "rule_rank", F.coalesce("s", "score").alias("score"), F.coalesce("why", "reasons").alias("reasons"), F.coalesce("c", F.lit(0.5)).alias("confidence")
    )
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), "rule_rank")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fallback_reasons() -> Column:
    """At most four short reasons where no model explains: areas, techniques, method, access. Their labels are fixed values."""
    shared = research_area_match()
    area = F.when(F.size(arr("research_area")) > 0, F.when(F.size(shared) > 0, F.concat(F.lit("领域匹配："), F.array_join(shared, ", "))).otherwise(F.concat(F.lit("领域："), F.array_join(F.slice("research_area", 1, 2), ", "))))
    technique = F.when(F.size(arr("techniques")) > 0, F.concat(F.lit("技术："), F.array_join(F.slice("techniques", 1, 2), ", ")))

    def label(c: str, prefix: str, names: dict[str, str]) -> Column:
        shown = F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in names.items()], F.col(c))
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(prefix), shown))

    method = label("method_type", "类型：", {"method": "方法论", "system": "系统设计", "experiment": "实验", "survey": "综述"})
    access = label("oa_type", "出版：", {"full_oa": "完全OA", "hybrid": "混合OA", "subscription": "订阅"})
    found = F.slice(F.filter(F.array(area, technique, method, access), lambda r: r.isNotNull()), 1, 4)
    return F.when(F.size(found) == 0, F.array(F.lit("匹配度较高"))).otherwise(found)


#: fixed values: words of strong and weak abstracts
STRONG = ("state-of-the-art", "novel", "significant", "improves", "achieves")
WEAK = ("preliminary", "limited", "初步", "简单")


def strength(abstract: Column) -> Column:
    """The offline estimate of a paper's strength."""
    low = F.lower(abstract)
    up = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in STRONG])
    down = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in WEAK])
    return F.when(F.coalesce(abstract, F.lit("")) == "", 0.4).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.9), F.round(0.5 + 0.1 * (up - down), 6))))


def strength_level(s: Column) -> Column:
    return F.when(s >= 0.65, "A").when(s >= 0.45, "B").when(s >= 0.25, "C").otherwise("D")


def strength_band(s: Column) -> Column:
    return F.when(s.isNull(), "unknown").when(s >= 0.65, "strong").when(s >= 0.5, "medium").otherwise("weak")


def readiness(s: Column, novelty: Column) -> Column:
    return F.when((s >= 0.6) & (novelty >= 2), "Ready").when(s >= 0.35, "Preliminary").otherwise("Needs-Revision")


def assessed(n: Column, rigor: Column, reproducibility: Column, significance: Column, clarity: Column) -> Column:
    """Strength from five scores of 0..3; an absent score is 1. The weights are fixed values."""
    s = [F.coalesce(c, F.lit(1)) for c in (n, rigor, reproducibility, significance, clarity)]
    return F.least((0.35 * s[0] + 0.25 * s[1] + 0.15 * s[2] + 0.15 * s[3] + 0.10 * s[4]) / 3, F.lit(1.0))


def level_matches(band: Column, rating: Column) -> Column:
    return (
        ((band == "strong") & rating.isin("A", "B")) | ((band == "medium") & rating.isin("B", "C")) | ((band == "weak") & (rating.isNull() | rating.isin("C", "N/A")))
    )
