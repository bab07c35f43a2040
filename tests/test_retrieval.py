import math
import random

from pyspark.sql import functions as F

from folioforge.operators import blocks, bm25, retrieve, wordsearch


def naive_okapi(docs, query, k):
    n, toks = len(docs), [d.lower().split() for d in docs]
    avg = sum(map(len, toks)) / n
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    scores = []
    for i, t in enumerate(toks):
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.lower().split())
        scores.append((-round(s, 6) + 0.0, i))
    return [(i, -s + 0.0) for s, i in sorted(scores)[:k]]


def test_okapi_equals_scoring_every_document(spark):
    rng = random.Random(5)
    for _ in range(6):
        docs = [" ".join(rng.choices("abcdefg", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 14))]
        queries = [" ".join(rng.choices("abcxyz", k=rng.randint(0, 5))) for _ in range(4)]
        d = spark.createDataFrame(list(enumerate(docs)), "id long, t string").withColumn("pos", F.col("id"))
        q = spark.createDataFrame(list(enumerate(queries)), "q long, t string")
        got = bm25.okapi_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t"), 5).orderBy("q", "rank").collect()
        for i, text in enumerate(queries):
            assert [(r.id, round(r.score, 4) + 0.0) for r in got if r.q == i] == [(a, round(b, 4) + 0.0) for a, b in naive_okapi(docs, text, 5)]


def test_hot_terms_are_salted_without_change(spark, monkeypatch):
    rng = random.Random(9)
    docs = ["a a b" if i % 3 == 0 else " ".join(rng.choices("abcdefg", k=5)) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, t string").withColumn("pos", F.col("id"))
    q = spark.createDataFrame([(0, "a b x"), (1, "a g"), (2, None)], "q long, t string")
    monkeypatch.setattr(bm25, "SALTED", 5)
    got = bm25.okapi_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t"), 7).orderBy("q", "rank").collect()
    for i, text in enumerate(["a b x", "a g", ""]):
        assert [(r.id, round(r.score, 4) + 0.0) for r in got if r.q == i] == [(a, round(b, 4) + 0.0) for a, b in naive_okapi(docs, text, 7)]


def test_empty_corpus(spark):
    d = spark.createDataFrame([], "id long, t string").withColumn("pos", F.col("id"))
    q = spark.createDataFrame([(1, "a")], "q long, t string")
    assert bm25.okapi_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t"), 5).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_ROWS", 2)
    monkeypatch.setattr(blocks, "CORPUS_ROWS", 3)
    monkeypatch.setattr(retrieve, "AT_ONCE", 1)
    rng = random.Random(1)
    vs = [(i, [rng.random() for _ in range(3)]) for i in range(20)] + [(99, None), (98, [1.0])]
    d = spark.createDataFrame(vs, "id long, v array<double>")
    q = d.where("id < 5").withColumnRenamed("id", "q")
    got = retrieve.vector_topk(q, "q", d, "id", "v", 3).orderBy("q", "rank").collect()
    for i in range(5):
        want = sorted((sum((a - b) ** 2 for a, b in zip(vs[i][1], v)), j) for j, v in vs[:20])[:3]
        assert [r.id for r in got if r.q == i] == [j for _, j in want]


def test_min_max_and_fusion_ties(spark):
    hits = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 1.0, 2), (2, "a", 2.0, 1), (2, "c", 2.0, 2)], "p long, v string, score double, rank int")
    norm = {(r.p, r.v): r.n for r in hits.withColumn("n", retrieve.min_max(["p"], 0.5)).collect()}
    assert norm == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): 0.5, (2, "c"): 0.5}
    fused = retrieve.fuse({"bm25": hits, "text": hits}, "p", "v", 5).orderBy("p", "rank").collect()
    assert [(r.p, r.v, r.score) for r in fused] == [(1, "a", 0.65), (1, "b", 0.0), (2, "a", 0.0), (2, "c", 0.0)]


def test_overlap_search(spark):
    d = spark.createDataFrame([(1, "deep learning"), (2, "graph theory"), (3, None)], "id long, t string").withColumn("pos", F.col("id"))
    q = spark.createDataFrame([(7, "Deep graph nets"), (8, "")], "q long, t string")
    got = retrieve.overlap_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t")).collect()
    assert [(r.q, r.id, round(r.score, 4)) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 1, 0.3333), (7, 2, 0.3333)]


def test_okapi_writes_no_table_of_all_matches(spark, monkeypatch):
    rows, cut = [], bm25.cut
    monkeypatch.setattr(bm25, "cut", lambda df, *a: rows.append((out := cut(df, *a)).count()) or out)
    d = spark.range(300).select("id", F.concat(F.lit("a b w"), (F.col("id") % 7).cast("string")).alias("t"), F.col("id").alias("pos"))
    q = spark.range(40).select(F.col("id").alias("q"), F.lit("a b w3").alias("t"))
    got = bm25.okapi_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t"), 4).orderBy("q", "rank").collect()
    assert [r.id for r in got] == [3, 10, 17, 24] * 40
    assert max(rows) <= 300


def test_overlap_search_in_blocks(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 5), ("CORPUS_ROWS", 9), ("AT_ONCE", 2), ("GROUPS", 4)):
        monkeypatch.setattr(wordsearch, name, value)
    rng = random.Random(3)
    docs, queries = ([" ".join(rng.choices("abcdefghij", k=rng.randint(0, 6))) for _ in range(n)] for n in (60, 12))
    d = spark.createDataFrame(list(enumerate(docs)), "id long, t string").withColumn("pos", -F.col("id"))
    q = spark.createDataFrame(list(enumerate(queries)), "q long, t string")
    for k in (3, 7):  # fewer and more than the groups
        got = retrieve.overlap_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t"), k).orderBy("q", "rank").collect()
        for i, text in enumerate(queries):
            asked = set(text.split())
            share = sorted((-round(len(asked & set(t.split())) / len(asked), 6), -j) for j, t in enumerate(docs) if asked & set(t.split()))
            assert [(r.id, r.score) for r in got if r.q == i] == [(-j, -s) for s, j in share[:k]]


def test_okapi_in_blocks(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 5), ("CORPUS_ROWS", 9), ("AT_ONCE", 2), ("GROUPS", 4), ("LOOK_UP", 0)):
        monkeypatch.setattr(wordsearch, name, value)
    rng = random.Random(4)
    docs, queries = ([" ".join(rng.choices("aabcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 6))) for _ in range(n)] for n in (60, 12))
    d = spark.createDataFrame(list(enumerate(docs)), "id long, t string").withColumn("pos", F.col("id"))
    q = spark.createDataFrame(list(enumerate(queries)), "q long, t string")
    for k in (3, 7):
        got = bm25.okapi_topk(q, "q", F.col("t"), d, "id", "pos", F.col("t"), k).orderBy("q", "rank").collect()
        for i, text in enumerate(queries):
            assert [(r.id, round(r.score, 4) + 0.0) for r in got if r.q == i] == [(a, round(b, 4) + 0.0) for a, b in naive_okapi(docs, text, k)]


def test_lexical_routes_meet_once_and_equal_the_searches(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 5), ("CORPUS_ROWS", 9), ("AT_ONCE", 2), ("GROUPS", 4), ("CELLS", 3)):
        monkeypatch.setattr(wordsearch, name, value)
    meetings, in_blocks = [], wordsearch.in_blocks
    monkeypatch.setattr(wordsearch, "in_blocks", lambda *a: meetings.append(a) or in_blocks(*a))
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 6))), -i) for i in range(60)]
    d = spark.createDataFrame([(str(i), t, p) for i, t, p in docs], "journal_id string, scope_text string, pos long").selectExpr("*", "'' as journal_name", "array() as keywords", "array() as subject_tags")
    rows = [(i, " ".join(rng.choices("abcxyz", k=rng.randint(0, 5))), rng.choice("xyz"), ["title", "full", "abstract", None][i % 4]) for i in range(12)]
    q = spark.createDataFrame(rows, "q long, r string, s string, mode string").withColumn("s", F.when(F.col("q") > 2, F.col("s")).otherwise(F.col("r")))
    sizes = {"bm25": retrieve.route_size("bm25"), "text": retrieve.route_size("text")}
    got = retrieve.lexical_routes(q, "q", F.col("r"), F.col("s"), d, "journal_id", "pos", F.col("scope_text"), sizes)
    assert len(meetings) == 1
    k = F.col("rank") <= F.col("k")
    for route, hits in (
        ("bm25", bm25.okapi_topk(q, "q", F.col("r"), d, "journal_id", "pos", F.col("scope_text"), 32)),
        ("text", retrieve.overlap_topk(q, "q", F.col("s"), d, "journal_id", "pos", F.col("scope_text"), 16)),
    ):
        want = hits.join(q.select("q", sizes[route].alias("k")), "q").where(k).drop("k")
        assert sorted(map(tuple, got[route].collect())) == sorted(map(tuple, want.collect())), route


def test_meetings_are_spread_over_the_tasks(spark):
    numbers = spark.range(50).select(F.col("id").cast("int").alias("i"), F.hash(F.col("id").cast("int")).alias("h")).collect()
    assert all(blocks.spark_hash(r.i) == r.h for r in numbers)
    for n, partitions in ((9, 14), (14, 14), (40, 12)):
        tasks = [blocks.spark_hash(x) % partitions for x in blocks.labels_apart(n, partitions)]
        assert max(tasks.count(t) for t in range(partitions)) == -(-n // partitions)
