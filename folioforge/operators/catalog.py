"""Building the catalogue: defaults, tags, name matching, enrichment."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut, lookup
from .blocks import in_blocks
from .tables import arr

#: fixed values: the words of a short taxonomy
TAXONOMY = {
    "ai": ("AI", "人工智能", "机器学习", "深度学习"), "cv": ("CV", "Computer Vision", "图像", "视频"), "nlp": ("NLP", "Natural Language Processing", "文本", "语言"),
    "se": ("SE", "Software Engineering", "软件", "系统"), "network": ("Network", "通信", "分布式", "云计算"), "security": ("Security", "安全", "加密", "隐私"),
    "db": ("DB", "Database", "数据", "存储"), "theory": ("Theory", "算法", "计算", "形式化"),
}
#: fixed values: words of subject terms and the tags they give
SUBJECT_RULES = (
    ("ai", ("artificial intelligence", "machine learning")), ("cv", ("computer vision", "image processing")), ("nlp", ("natural language", "computational linguistics")),
    ("se", ("software", "programming")), ("network", ("network", "internet")), ("security", ("security", "cryptography")), ("db", ("database", "data mining")),
    ("theory", ("theory", "computation")),
)
#: fixed values: the areas of the rating list and the terms that the directory keeps for each, in full: the stated scopes of the areas and the
#: subject tags of its enrichment table (scripts/build_ccf_journals.py:314-325, scripts/enrich_journals.py:25-285 of the original)
AREA_TERMS = {
    "计算机体系结构/并行与分布计算/存储系统": ("computer architecture", "parallel computing", "distributed systems", "storage systems", "high-performance computing", "cloud computing", "GPU computing", "multi-core processors", "microarchitecture", "storage", "file systems", "distributed storage", "VLSI", "CAD", "integrated circuits", "chip design", "processor design", "code optimization", "compiler"),
    "计算机网络": ("computer networks", "network protocols", "wireless communications", "mobile computing", "internet architecture", "network security", "distributed systems", "sensor networks", "5G", "SDN", "mobile networks", "wireless networks", "ubiquitous computing", "internet", "networking protocols", "routing"),
    "网络与信息安全": ("network security", "information security", "cryptography", "privacy", "cyber security", "intrusion detection", "secure computing", "malware analysis", "digital forensics", "information forensics", "security", "biometrics", "computer security"),
    "软件工程/系统软件/程序设计语言": ("software engineering", "programming languages", "system software", "software verification", "software testing", "software architecture", "compiler design", "programming methodology", "formal methods", "verification", "services computing", "cloud computing", "web services", "microservices", "distributed systems", "virtualization", "edge computing", "software practice", "programming", "development methodology"),
    "数据库/数据挖掘/内容检索": ("database systems", "data mining", "information retrieval", "knowledge engineering", "big data", "data warehousing", "query processing", "NoSQL", "text mining", "distributed databases", "machine learning", "VLDB", "knowledge discovery", "pattern mining", "information systems", "database", "e-commerce"),
    "计算机科学理论": ("theoretical computer science", "algorithms", "computational complexity", "logic", "automata theory", "computability", "formal methods", "cryptography theory", "data structures", "graph algorithms"),
    "计算机图形学与多媒体": ("computer graphics", "visualization", "multimedia", "image processing", "computer vision", "virtual reality", "augmented reality", "rendering", "visual analytics", "animation", "GPU", "VR/AR", "scientific visualization", "video processing", "audio processing", "multimedia retrieval", "geometric modeling"),
    "人工智能": ("artificial intelligence", "machine learning", "deep learning", "natural language processing", "computer vision", "robotics", "knowledge representation", "neural networks", "reinforcement learning", "AI", "NLP", "pattern recognition", "machine intelligence", "probabilistic models", "computational linguistics", "machine translation", "text mining", "computational intelligence", "evolutionary computation", "fuzzy systems", "knowledge-based systems", "knowledge graphs", "expert systems", "decision support", "intelligent systems", "AI applications", "information science", "soft computing"),
    "人机交互与普适计算": ("human-computer interaction", "ubiquitous computing", "pervasive computing", "user interface design", "interaction design", "accessibility", "mobile devices", "social computing", "HCI", "user interface", "usability", "interactive systems"),
    "交叉/综合/新兴": ("interdisciplinary research", "emerging technologies", "cross-domain applications", "computational intelligence", "smart systems", "novel computing paradigms"),
}
#: the place of a venue without a corpus position
LAST = 1 << 62
RATING_QUARTILE = {"A": "Q1", "B": "Q2", "C": "Q3"}


def with_defaults(v: DataFrame) -> DataFrame:
    """Fills quartile, rank, impact, review time, paper types, submission address and scope where they are absent."""
    impact = F.when(F.coalesce("impact_like_score", F.lit(0.0)) != 0, F.col("impact_like_score")).when(
        F.coalesce("sqr_rank", F.lit(0)) != 0, F.greatest(F.lit(0.1), 10 - F.col("sqr_rank") / 20)
    )
    keywords = F.array_join(F.slice(arr("keywords"), 1, 10), ", ")
    return v.select(
        "journal_id", "pos",
        F.coalesce("quartile", F.when(F.col("oa_type") == "full_oa", "Q2").otherwise("Q3")).alias("quartile"),
        F.coalesce("sqr_rank", F.lit(100)).alias("sqr_rank"),
        F.round(F.coalesce(impact, F.lit(3.0)), 6).alias("impact_like_score"),
        F.coalesce("review_time", F.lit("3-6 months")).alias("review_time"),
        F.array_join(F.coalesce("target_paper_type", F.array(F.lit("method"), F.lit("experiment"))), ",").alias("target_paper_type"),
        F.coalesce("submission_url", "homepage_url", F.lit("")).alias("submission_url"),
        F.coalesce("apc", F.lit(0.0)).alias("apc"),
        F.when(F.coalesce("scope_text", F.lit("")) != "", F.col("scope_text")).otherwise(keywords).alias("scope_text"),
    )


def rating_quartile(rating: Column) -> Column:
    return F.coalesce(*[F.when(rating == r, F.lit(q)) for r, q in RATING_QUARTILE.items()])


def needs_enrichment() -> Column:
    return (F.size(arr("subject_tags")) == 0) | (F.coalesce(F.array_join("subject_tags", "|"), F.lit("")) == "other") | (F.length(F.trim(F.coalesce("scope_text", F.lit("")))) < 30)


def taxonomy_tags(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(F.exists(F.array(*[F.lit(w.lower()) for w in ws]), lambda w: F.contains(low, w)), F.lit(t)) for t, ws in TAXONOMY.items()]
    return F.array_sort(F.filter(F.array(*found), lambda t: t.isNotNull()))


def taxonomy_keywords(tag: str) -> tuple[str, ...]:
    return TAXONOMY.get(tag, ())


def subject_tags(terms: Column) -> Column:
    """Tags of an array of subject terms, in alphabetical order, at most five; ``other`` if there are none."""
    low = F.lower(F.array_join(F.coalesce(terms, F.array().cast("array<string>")), "|"))
    found = []
    for tag, ws in SUBJECT_RULES:
        hit = F.lit(False)
        for w in ws:
            hit = hit | F.contains(low, F.lit(w))
        found.append(F.when(hit, F.lit(tag)))
    tags = F.slice(F.array_sort(F.filter(F.array(*found), lambda t: t.isNotNull())), 1, 5)
    return F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags)


def topic_scope(topics: Column) -> Column:
    """A sentence (its templates are fixed values) on one, two or at least three topics; those from the fourth on are named as related if there are any."""
    n = F.size(F.coalesce(topics, F.array().cast("array<string>")))
    many = F.concat(F.lit("Covers "), F.array_join(F.slice(topics, 1, 3), ", "), F.when(n > 3, F.concat(F.lit(", and related topics including "), F.array_join(F.slice(topics, 4, 3), ", "))).otherwise(F.lit("")), F.lit("."))
    return (
        F.when(n == 0, F.lit("")).when(n == 1, F.concat(F.lit("Covers all aspects of "), F.get(topics, F.lit(0)), F.lit(".")))
        .when(n == 2, F.concat(F.lit("Focuses on "), F.get(topics, F.lit(0)), F.lit(" and "), F.get(topics, F.lit(1)), F.lit("."))).otherwise(many)
    )


def spaced_name(name: Column) -> Column:
    """Words run together get their spaces back where the case changes."""
    return F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", " ")


def new_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old.select("journal_id").distinct(), "journal_id", "left_anti")


def fuzzy_matches(names: DataFrame, key: str, name: str, venues: DataFrame, least: float = 0.6, by_word: float = 0.7) -> DataFrame:
    """(key, journal_id, ratio): each name's best venue; ties go to the smaller corpus position.

    A venue's score is the InDel ratio of the lower-case names, and at least ``by_word`` if one of the venue's
    words stands anywhere in the name; scores below ``least`` are none. Distinct names meet all distinct venue
    names block by block. Within a block the characters that two names share bound their ratio from above, so
    that only pairs which could still be the best are compared; none is lost. Null and blank names match nothing.
    """
    typed = names.select(key, tx.normal_name(F.col(name)).alias("a")).where("a <> ''")
    asked = typed.groupBy("a").agg(F.count(F.lit(1)).alias("facts"))
    held = (
        venues.select(tx.normal_name(F.col("journal_name")).alias("b"), F.coalesce("pos", F.lit(LAST)).cast("long").alias("pos"), F.col("journal_id").cast("string").alias("j")).where("b <> ''")
        .groupBy("b").agg(F.min(F.struct("pos", "j")).alias("v")).select("b", "v.pos", "v.j")
    )

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        vs = vs.sort_values("pos").reset_index(drop=True)
        bs, sizes = vs["b"].tolist(), vs["b"].map(len).to_numpy()
        chars = {c: i for i, c in enumerate(sorted(set("".join(bs))))}
        bags = np.zeros((len(bs), len(chars)), dtype=np.int32)
        first: dict[str, int] = {}
        for i, b in enumerate(bs):
            for c, n in Counter(b).items():
                bags[i, chars[c]] = n
            for w in b.split():
                first.setdefault(w, i)
        found = []
        for a in qs["a"]:
            hits = [i for w, i in first.items() if w in a]
            score, at = (by_word, min(hits)) if hits else (0.0, -1)
            mine = np.zeros(len(chars), dtype=np.int32)
            for c, n in Counter(a).items():
                if c in chars:
                    mine[chars[c]] = n
            bound = 2.0 * np.minimum(bags, mine).sum(axis=1) / (sizes + len(a))
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < max(score, least):
                    break
                ratio = tx.indel(a, bs[i])
                if ratio >= least and (ratio > score or ratio == score and i < at):
                    score, at = ratio, int(i)
            if at >= 0 and score >= least:
                found.append((a, float(score), int(vs["pos"][at]), vs["j"][at]))
        return pd.DataFrame(found, columns=["a", "ratio", "pos", "j"])

    scored = in_blocks(asked, "a", held, "b", best, "a string, ratio double, pos long, j string")
    top = scored.groupBy("a").agg(F.max(F.struct("ratio", (-F.col("pos")).alias("first"), "j")).alias("m")).select("a", F.col("m.j").alias("journal_id"), F.round("m.ratio", 6).alias("ratio"))
    return lookup(typed, cut(top.join(asked, "a")), ["a"], "facts", typed.count()).select(key, "journal_id", "ratio")


def contained(names: DataFrame, key: str, name: str, venues: DataFrame, longer: int = 10) -> DataFrame:
    """(key, journal_id): of the venues whose name stands in the given name, or in whose name it stands, the first in corpus order.

    The name that stands in the other has over ``longer`` characters. The distinct names of the stated query set meet
    all distinct venue names block by block. Null and blank names match nothing.
    """
    typed = names.select(key, tx.normal_name(F.col(name)).alias("a")).where("a <> ''")
    asked = typed.groupBy("a").agg(F.count(F.lit(1)).alias("facts"))
    held = (
        venues.select(tx.normal_name(F.col("journal_name")).alias("b"), F.coalesce("pos", F.lit(LAST)).cast("long").alias("pos"), F.col("journal_id").cast("string").alias("j")).where("b <> ''")
        .groupBy("b").agg(F.min(F.struct("pos", "j")).alias("v")).select("b", "v.pos", "v.j")
    )

    def first(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        vs = vs.sort_values("pos")
        known = list(zip(vs["b"], vs["pos"], vs["j"]))
        found = []
        for a in qs["a"]:
            hit = next(((a, p, j) for b, p, j in known if len(b) > longer and b in a or len(a) > longer and a in b), None)
            found += [hit] if hit else []
        return pd.DataFrame(found, columns=["a", "pos", "j"])

    met = in_blocks(asked, "a", held, "b", first, "a string, pos long, j string")
    top = met.groupBy("a").agg(F.min(F.struct("pos", "j")).alias("m")).select("a", F.col("m.j").alias("journal_id"))
    return lookup(typed, cut(top.join(asked, "a")), ["a"], "facts", typed.count()).select(key, "journal_id")


def full_cascade(names: DataFrame, key: str, name: str, venues: DataFrame) -> DataFrame:
    """(key, journal_id, tier): 1 the exact name, 2 one name within the other, 3 the same abbreviation, 4 nothing."""
    near = cascade(names, key, name, venues).withColumnRenamed("journal_id", "j13")
    within = contained(names, key, name, venues).select(key, F.col("journal_id").alias("j2"))
    tier = F.when(F.col("tier") == 1, 1).when(F.col("j2").isNotNull(), 2).when(F.col("tier") == 2, 3).otherwise(4)
    joined = near.join(within, key, "left")
    return joined.select(key, F.when(tier == 2, F.col("j2")).otherwise(F.col("j13")).alias("journal_id"), tier.alias("tier"))


def rated(venues: DataFrame) -> DataFrame:
    """The rows of a rating list: rated venues with their first tag and the rating's own tags, and the quartile of the rating."""
    rating = F.col("ccf_rating")
    tags = F.array(F.coalesce(F.get("subject_tags", F.lit(0)), F.lit("")), F.concat(F.lit("CCF-"), rating), F.lit("CCF推荐"))
    return venues.where(rating.isin(*RATING_QUARTILE)).select("journal_id", tags.alias("subject_tags"), rating.alias("ccf_rank"), rating_quartile(rating).alias("quartile"))


def cascade(names: DataFrame, key: str, name: str, venues: DataFrame) -> DataFrame:
    """(key, journal_id, tier): exact name first, then the same abbreviation of letters and digits, else nothing (tier 3)."""
    a = names.select(key, tx.normal_name(F.col(name)).alias("n"), tx.abbreviation(F.col(name)).alias("ab"))
    first = Window.partitionBy("m").orderBy("pos")

    def side(c: Column) -> DataFrame:
        return venues.select(c.alias("m"), "journal_id", "pos").where("m <> ''").withColumn("r", F.row_number().over(first)).where("r = 1").select("m", "journal_id")

    exact = side(tx.normal_name(F.col("journal_name"))).select(F.col("m").alias("n"), F.col("journal_id").alias("j1"))
    short = side(tx.abbreviation(F.col("journal_name"))).select(F.col("m").alias("ab"), F.col("journal_id").alias("j2"))
    return a.join(exact, "n", "left").join(short, "ab", "left").select(
        key, F.coalesce("j1", "j2").alias("journal_id"), F.when(F.col("j1").isNotNull(), 1).when(F.col("j2").isNotNull(), 2).otherwise(3).alias("tier")
    )


def keyword_verified(target: Column, actual: Column) -> Column:
    """Whether three fifths of the target's words of over two letters stand in the actual name."""
    ws = F.filter(tx.token_set(target), lambda w: F.length(w) > 2)
    held = F.size(F.filter(ws, lambda w: F.contains(F.lower(actual), w)))
    return F.coalesce((F.size(ws) > 0) & (held >= 0.6 * F.size(ws)), F.lit(False))


def enriched(venues: DataFrame, known: DataFrame) -> DataFrame:
    """Fills scope and tags of venues that need it from a table of known names (name, scope, tags, pos), by lower-case name; of several rows the first by ``pos``."""
    best = known.groupBy(tx.normal_name(F.col("name")).alias("n")).agg(F.min_by(F.struct("scope", "tags"), "pos").alias("k")).select("n", "k.scope", "k.tags")
    joined = venues.withColumn("n", tx.normal_name(F.col("journal_name"))).join(best, "n", "left")
    need = needs_enrichment()
    return joined.withColumns({
        "scope_text": F.when(need & F.col("scope").isNotNull(), F.col("scope")).otherwise(F.col("scope_text")),
        "subject_tags": F.when(need & F.col("tags").isNotNull(), F.col("tags")).otherwise(F.col("subject_tags")),
    }).drop("n", "scope", "tags")
