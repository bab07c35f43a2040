from pyspark.sql import functions as F

from folioforge.operators import rules

PAIR = (
    "paper_id long, journal_id string, pos long, title string, abstract string, research_area array<string>, keywords array<string>, techniques array<string>, datasets array<string>, "
    "evaluation_metrics array<string>, method_type string, paper_type string, novelty_type string, paper_strength double, journal_name string, scope_text string, venue_keywords array<string>, "
    "subject_tags array<string>, oa_type string, target_paper_type array<string>, ccf_rating string"
)
FULL = (1, "j", 0, "Deep Graph Nets", "we study", ["ai"], ["Graph"], ["graph attention"], ["ImageNet"], ["F1"], "method", "theory", "benchmark", 0.7,
        "Journal of Graph Studies", "graph attention theory with image net and f1-score benchmark", ["graph"], ["ai", "db"], "hybrid", ["method"], "A")
EMPTY = (1, "k", 1, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)


def test_features_and_nulls(spark):
    df = rules.scored(spark.createDataFrame([FULL, EMPTY], PAIR), "hybrid").withColumn("reasons", rules.reasons())
    a, b = df.orderBy("pos").collect()
    assert (a.title_journal_name, a.journal_name_keyword, a.method_type_match, a.paper_type_match, a.dataset_match, a.metric_match, a.novelty_match, a.oa_preference_match) == (1, 1, 1, 1, 1, 1, 1, 1)
    assert a.score > 5 and len(a.reasons) >= 5
    assert b.score == 0 and b.reasons == []


def test_rank_adjust_and_merge(spark):
    rows = [(1, "a", 0, 2.0, 0.7, "C"), (1, "b", 1, 2.0, 0.7, "A"), (1, "c", 2, 1.0, 0.7, None), (2, "a", 0, 1.0, None, "A")]
    df = spark.createDataFrame(rows, "paper_id long, journal_id string, pos long, score double, paper_strength double, ccf_rating string")
    adj = rules.adjusted(rules.ranked(df))
    assert [(r.journal_id, r.rank) for r in adj.where("paper_id = 1").orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    assert adj.where("paper_id = 2").first().adjusted == 1.0
    ans = spark.createDataFrame([(1, 0, "c", 9.0, None, None), (1, 1, "c", 8.0, ["x"], 0.9), (1, 2, "zz", 7.0, None, None)], "paper_id long, no int, journal_id string, score double, reasons array<string>, confidence double")
    got = rules.merged_rerank(adj.withColumn("reasons", F.array(F.lit("r"))), ans).collect()
    assert [(r.journal_id, r.score, r.confidence, r.reasons) for r in got] == [("c", 8.0, 0.9, ["x"])]


def test_strength_and_bands(spark):
    df = spark.createDataFrame([("", ), ("Novel and significant", ), ("preliminary, limited, 初步 简单", ), (None, )], "a string")
    assert [r.s for r in df.select(rules.strength(F.col("a")).alias("s")).collect()] == [0.4, 0.7, 0.2, 0.4]
    b = spark.createDataFrame([(0.8,), (0.69,), (0.5,), (0.39,), (None,)], "s double").select(rules.strength_band(F.col("s")).alias("b"), rules.strength_level(F.col("s")).alias("l")).collect()
    assert [r.b for r in b] == ["strong", "strong", "medium", "weak", "unknown"]
    assert [r.l for r in b][:4] == ["A", "A", "B", "C"]


def test_combined(spark):
    df = spark.sql("select map('a', 2.0D, 'b', 3.0D) w, map('a', 0.5D, 'c', 9.0D) f")
    assert df.select(rules.combined(F.col("w"), F.col("f")).alias("x")).first().x == 1.0
