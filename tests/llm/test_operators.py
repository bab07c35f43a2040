"""The nine operators on small tables: nulls, empties, ties, repeated rows, extra columns, and brute force."""

import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("folioforge.llm")
from folioforge import session  # noqa: E402
from folioforge.llm import p1_scan, p2_canon, p3_survivor, p4_ledger, p5_names, p6_link, p7_pack, p8_mix, p9_sentences  # noqa: E402

VENUES = (
    "pos long, journal_id string, journal_name string, publisher string, subject_tags array<string>, keywords array<string>, scope_text string, submission_url string, "
    "homepage_url string, source string, fetched_at timestamp, extra string"
)
FEEDS = "source string, trust_rank int"
AREAS = "entry_id string, vocab string, label string, label_zh string, aliases array<string>"
BLOCKS = "block_id long, paper_id long, page int, y0 double, x0 double, text string"


# 1
def test_p1_repairs(spark):
    body = ["The authors study the systems with care and the reviewers", "follow the rules of the journal in every issue of the year."]
    papers = [(i, "\n".join(["A Title", "A. Author", *body * 3, "Preprint, 2020", f"Page {i}"])) for i in range(8)]
    noisy = "\n".join(["A Title", "A. Author", "The authors sfudy the systems with care and the revi-", "ewers follow the rules of the journa1 in every issue.", "Page 99", "A. Author", "the end of all", "Page 100"])
    p = spark.createDataFrame([*papers, (50, noisy), (50, noisy), (51, None), (52, "")], "paper_id long, full_text string")
    b = spark.createDataFrame([(1, 9, 1, 20.0, 0.0, "second line"), (2, None, None, None, None, None), (3, 9, 1, 10.0, 0.0, "first line")], BLOCKS)
    got = {tuple(r) for r in p1_scan.found(p, b).where("rec_id = 50").collect()}
    assert got == {
        ("papers", 50, 4, "furniture", ""), ("papers", 50, 5, "furniture", ""), ("papers", 50, 7, "furniture", ""),
        ("papers", 50, 2, "hyphen", "reviewers"), ("papers", 50, 2, "ocr", "study"), ("papers", 50, 3, "ocr", "journal"),
    }
    text = " ".join(r.text for r in p1_scan.paragraphs(p, b).where("doc = 'p50'").orderBy("para").collect())
    assert "study the systems with care and the reviewers follow the rules of the journal in every issue. the end" in text
    assert p1_scan.found(p.limit(0), b.limit(0)).count() == 0


# 2
def brute_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_p2_automaton_equals_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(60)]
    trie = p2_canon.Trie()
    for w in words:
        trie.add(w, w, 0)
    for _ in range(150):
        text = "".join(rng.choices("abcd", k=rng.randint(1, 8)))
        for limit in (0, 1, 2):
            assert {(d, e) for d, _, e in trie.search(text, limit)} == {(brute_distance(text, w), w) for w in words if brute_distance(text, w) <= limit}


def test_p2_maps(spark):
    areas = spark.createDataFrame([("t1", "tag", "vision", "计算机视觉", ["computer vision"]), ("t2", "tag", "hci", None, None), ("a1", "area", "Security and privacy", "安全与隐私", ["information security"])], AREAS)
    tags = ["compter vision", "vision", None, " ", "Vision, computer", "计算机视觉领域", "bee keeping", "vision ", "vision", "human-computer interact.", "?"]
    v = spark.createDataFrame([(1, tags, "x"), (2, None, "y")], "pos long, subject_tags array<string>, entry_id string")
    p = spark.createDataFrame([(5, ["privacy, Security"], ["cyber-security", "Security and privacy"])], "profile_id long, research_area array<string>, ccf_research_area array<string>")
    got = {(r.field_name, r.rec_id, r.raw_value): r.entry_id for r in p2_canon.map_values(p2_canon.elements(v, p), areas).collect()}
    assert got == {
        ("subject_tags", 1, "compter vision"): "t1", ("subject_tags", 1, "Vision, computer"): "t1", ("subject_tags", 1, "计算机视觉领域"): "t1", ("subject_tags", 1, "bee keeping"): "unmatched",
        ("subject_tags", 1, "vision "): "t1", ("subject_tags", 1, "human-computer interact."): "t2", ("subject_tags", 1, "?"): "unmatched",
        ("research_area", 5, "privacy, Security"): "a1", ("ccf_research_area", 5, "cyber-security"): "unmatched",
    }
    named = p2_canon.map_values(p2_canon.elements(v, p), areas, [("infosec", "information security", "cyber security")])
    assert named.where("raw_value = 'cyber-security'").first().entry_id == "a1"  # an alias path that the caller knows
    assert {r.entry_id for r in p2_canon.map_values(p2_canon.elements(v, p), areas.limit(0)).collect()} == {"unmatched"}


# 3
def test_p2_derived_paths():
    m = p2_canon.Matcher([("a1", "Parallel computing, architecture and storage", "并行计算、存储与体系结构", []), ("a2", "Theory of computation", None, ["HCI"]), ("a3", "Computer graphics", None, [])], [])
    for value, entry in (("storage", "a1"), ("architecture & storage", "a1"), ("archit. / storage", "a1"), ("存储体系结构", "a1"), ("theory", "a2"), ("CG", "a3"), ("Computergrafik", "a3"), ("human computer interaction", "a2"), ("computer graph.", "a3")):
        assert min(m.all_near(value))[2] == entry, value
    assert not m.all_near("fluid mechanics") and not m.all_near("x")


def test_p2_groups_give_terms_to_one_entry():
    entries = [("a1", "Security and privacy", "安全与隐私", ["information security"]), ("a2", "Networks and communication", "网络与数据通信", ["computer networks"]), ("a3", "Robots", None, [])]
    groups = [("网络与信息安全", "information security", "privacy", "intrusion detection"), ("计算机网络", "computer networks", "routing", "network protocols"), ("ai", "robots", "smart systems")]
    m = p2_canon.Matcher(entries, groups)
    for value, entry in (("intrusion detection", "a1"), ("intrusoin detection", "a1"), ("routing", "a2"), ("privacy & intrusion", "a1"), ("routing protocols", "a2")):
        assert min(m.all_near(value))[2] == entry, value
    assert not m.all_near("routing detection") and not m.all_near("robot detection")  # words of two entries
    narrow = p2_canon.Matcher([("t1", "privacy", None, [])], groups)  # one subject of several that the group lists
    assert not narrow.all_near("intrusion detection")


def test_p2_area_groups_and_the_other_vocabulary(spark):
    areas = spark.createDataFrame([("a1", "area", "Networks and communication", "网络与数据通信", ["computer networking"]), ("t1", "tag", "network", "网络与通信", ["computer networks"]), ("a2", "area", "Artificial intelligence", None, ["AI"]), ("a3", "area", "Software engineering and programming languages", None, [])], AREAS)
    typed = spark.createDataFrame([(v, "area") for v in ("网络通信", "knowledge graphs", "expert systms", "compilers & software", "bee keeping")], "raw_value string, vocab string")
    got = {r.raw_value: r.entry_id for r in p2_canon.map_values(typed, areas, p2_canon.area_groups()).collect()}
    assert got == {"网络通信": "a1", "knowledge graphs": "a2", "expert systms": "a2", "compilers & software": "a3", "bee keeping": "unmatched"}


def test_p3_survivor(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2030, 1, n)
    whole = "The venue publishes research on graphs. It is good."
    rows = [
        (1, "a", "n", "p", ["ai", "db"], ["k"], whole, "https://x.example/a", None, "s1", day(1), "e"),
        (2, "a", "n", "p", ["ai"], ["n/a"], whole[:30], "https://", None, "s2", day(9), "e"),
        (3, "a", "n", "p", ["ai", "db"], [], "N/A", "https://x.example/b", None, "s2", day(2), "e"),
        (4, "a", "n", "p", None, None, None, "https://x.example/c", None, "s1", day(2), "e"),
        (5, "b", "n", "p", ["ai"], ["k"], whole, "https://y.example", None, "s1", day(1), "e"),
        (6, "c", "n", "p", ["other"], [""], "Th� v�nu�", "404", None, "s9", None, "e"),
        (7, "c", "n", "p", ["other"], None, "", "#", None, None, None, "e"),
        (8, None, "n", "p", ["ai"], ["k"], whole, "https://y.example", None, "s1", day(1), "e"),
    ] + [(100 + i, f"g{i // 2}", "n", "p", ["ai", f"t{i // 2}"], ["k", f"w{i}"], f"{whole} Number {i // 2}.", f"https://z{i // 2}.example/s", None, f"s{1 + i % 2}", day(1 + i % 20), "e") for i in range(60)]
    # what stands where a value should be is known by its spread over unrelated venues
    rows += [(200 + i, f"g{i}", "n", "p", ["other"], ["n/a"], "N/A", "404", None, "s1", day(3), "e") for i in range(20)]
    feeds = spark.createDataFrame([("s1", 1), ("s2", 2)], FEEDS)
    got = {(r.journal_id, r.field_name): r.pos for r in p3_survivor.survivors(spark.createDataFrame(rows, VENUES), feeds).collect()}
    assert {k: v for k, v in got.items() if k[0] in "abc"} == {("a", "scope_text"): 1, ("a", "submission_url"): 4, ("a", "subject_tags"): 3, ("a", "keywords"): 1}
    gold = p3_survivor.golden(spark.createDataFrame(rows, VENUES), feeds).where("journal_id = 'a' and field_name = 'subject_tags'").first()
    assert gold.surviving == ["ai", "db"]
    assert p3_survivor.survivors(spark.createDataFrame([], VENUES), feeds).count() == 0


def test_p3_model_decides(spark):
    """Boilerplate that two venues' names happen to speak of: the share of signals is undecided, the fitted model is not."""
    import datetime as dt

    rows = []
    for i in range(60):
        topic = f"{chr(97 + i // 26)}{chr(97 + i % 26)}topic"
        for j in range(3):
            stock = (i + j) % 3 == 0
            name = "Journal of Pages" if i % 20 == 0 else f"Journal of {topic}"
            text = "Under construction, see the pages of the publisher." if stock else f"The venue publishes research on {topic}, edition {j % 2}. It is read widely."
            rows.append((3 * i + j, f"v{i}", name, "p", None, None, text, None, None, f"s{j}", dt.datetime(2030, 1, 1 + (9 if stock else j)), "e"))
    v, feeds = spark.createDataFrame(rows, VENUES), spark.createDataFrame([(f"s{j}", j) for j in range(3)], FEEDS)
    stock = {r[0] for r in rows if r[6].startswith("Under")}
    got, off = ({r.pos for r in p3_survivor.survivors(v, feeds, n).collect()} for n in (p3_survivor.ROUNDS, 0))
    assert len(got) == 60 and not got & stock
    assert off & stock


# 4
def test_p4_copies(spark):
    rec = lambda i, n: f'{{"journal_id":"{i}","journal_name":"{n}","publisher":null,"oa_type":"x"}}'
    lines = [(1, "s", rec("A-1", "Straße É")), (2, "s", ' {"journal_name": "STRASSE  é!", "journal_id":"a_1", "oa_type":"X"} '), (3, None, rec("A-1", "Strasse E")), (4, "s", None), (5, "s", None),
             (6, "s", "no json"), (7, "s", "No JSON."), (2, "s", ' {"journal_name": "STRASSE  é!", "journal_id":"a_1", "oa_type":"X"} ')]
    df = spark.createDataFrame(lines, "line_id long, source string, record string").withColumn("fetched_at", F.timestamp_seconds(F.col("line_id") * 86400)).withColumn("key", F.lit("clash"))
    assert {tuple(r) for r in p4_ledger.copy_lines(df).collect()} == {(1, 2), (4, 5), (6, 7)}
    assert sorted(r.copies for r in p4_ledger.records(df).collect()) == [1, 2, 2, 2]
    assert p4_ledger.copy_lines(df.limit(0)).count() == 0


def test_p4_ledger_is_reopened(spark, tmp_path, monkeypatch):
    rows = [(i, f'{{"journal_id": "j{i % 37}", "journal_name": "Name{i % 37}{"!" * (i % 3)}"}}') for i in range(400)]
    df = spark.createDataFrame(rows, "line_id long, record string").withColumn("fetched_at", F.timestamp_seconds(F.col("line_id")))
    keyed, root = p4_ledger.keyed_lines(df), f"file://{tmp_path}/ledger"
    p4_ledger.Ledger(spark, root).fold(keyed.where("line_id < 150"))
    monkeypatch.setattr(p4_ledger, "BUCKET_KEYS", 2)  # more buckets from the second batch on
    p4_ledger.Ledger(spark, root).fold(keyed.where("line_id >= 150 and line_id < 160"))
    again = p4_ledger.Ledger(spark, root)
    assert again.n_buckets > p4_ledger.LEAST_BUCKETS and len(again.places) <= again.n_buckets
    again.fold(keyed.where("line_id >= 160"))
    again.fold(keyed.limit(0))
    got = {r.key: (r.copies, r.first_line) for r in p4_ledger.Ledger(spark, root).read().collect()}
    assert got == {r.key: (r.copies, r.first_line) for r in p4_ledger.records(df).collect()} and sum(c for c, _ in got.values()) == 400
    assert len(list((tmp_path / "ledger" / "manifest").iterdir())) == 1


# 5
def test_p5_curve_and_similarity():
    rows, bands = p5_names.tune()
    assert rows * bands <= p5_names.HASHES and 1 - (1 - p5_names.SIMILARITY**rows) ** bands >= p5_names.RECALL
    same = lambda a, b: p5_names.name_similarity(p5_names.reading(a), p5_names.reading(b)) >= p5_names.LINK_AT
    full = "Annals of Dynamic Traffic Shaping, Dasetelenige Institute"
    for other in ("ADTSI (Dasetelenige)", "Dynamic Traffic Shaping @ Dasetelenige", "Ann. of Dyna. Traf. Shaping Dasetelenige Inst.", "annals dynamic trafic shaping dasetelenige institute", full):
        assert same(full, other), other
    for other in ("Annals of Dynamic Key Exchange, Dasetelenige Institute", "Annals of Dynamic Traffic Shaping, Fomuferumire Institute", "Letters in Dynamic Traffic Shaping Dasetelenige", ""):
        assert not same(full, other), other


def test_p5_entities(spark):
    full = "Annals of Dynamic Traffic Shaping, Dasetelenige Institute"
    names = [full, full.upper(), "ADTSI (Dasetelenige)", "Kilito Nemeke Letters in Elastic Anomaly Tracing", "Kilito Nemeke Lettrs in Elastic Anommaly Tracing", None, "", "???", full]
    df = spark.createDataFrame([(i + 1, n, 0.0) for i, n in enumerate(names)] + [(1, full, 0.0)], "entry_id long, journal_name string, score double")
    assert {tuple(r) for r in p5_names.pairs(df).collect()} == {(1, 2), (1, 3), (2, 3), (1, 9), (2, 9), (3, 9), (4, 5)}
    assert p5_names.pairs(df.limit(0)).count() == 0


def test_p5_hub_rounds_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    base = "Kilito Nemeke Letters in Elastic Anomaly Tracing"
    names = {base}
    while len(names) < 30:
        i = base.index("lastic") + rng.choice([0, 1, 2, 3, 9, 10, 11, 12, 17, 18, 19, 20])
        names.add(base[:i] + rng.choice("xyz") + base[i + 1 :])
    df = spark.createDataFrame(list(enumerate(sorted(names))), "entry_id long, journal_name string")
    _, distinct = p5_names.readings(df)
    monkeypatch.setattr(p5_names, "SMALL_BUCKET", 5)
    assert p5_names.entities(df).select("entity").distinct().count() == 1
    assert p5_names.stars(p5_names.links(distinct), distinct.select("id")).count() == distinct.count()


def test_p5_large_bucket_is_paired_in_full(spark, monkeypatch):
    # the bucket's most frequent reading explains the first of two that are siblings, and not the second
    names = ["Kilito Nemeke Elastic Tracing"] * 3 + ["Kilito Nemeke Elastic", "Kilito Nemeke Elastic Mapping"]
    _, distinct = p5_names.readings(spark.createDataFrame(list(enumerate(names)), "entry_id long, journal_name string"))
    monkeypatch.setattr(p5_names, "tune", lambda: (1, 1))
    monkeypatch.setattr(p5_names, "SMALL_BUCKET", 1)
    assert {(r.a, r.b) for r in p5_names.links(distinct).collect()} == {(0, 3), (3, 4)}


def test_p5_words_have_partners_of_their_own(spark):
    names = ["the Modelu Memoda memory models one", "Modelu Memoda Journal of Hybrid Memory Models", "the Momepakumode modular memory models one", "Nodunopotede visual tracking"]
    names += [f"{place} Journal of Hybr. Memo. Mode." for place in ("Diriva Polona", "Sagudi Lidipi", "Bilale Bafoso", "Kafopi Renu")] + ["Mopukemeradi Jnl Modu. Visua. Track."]
    df = spark.createDataFrame(list(enumerate(names)), "entry_id long, journal_name string")
    assert {tuple(r) for r in p5_names.pairs(df).collect()} == {(0, 1)}


def test_p5_partners_equal_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        w = [[rng.choice([p5_names.NO_PARTNER, 0.8, 0.97, rng.random()]) for _ in range(m)] for _ in range(n)]
        most = max(sum(row[k] for row, k in zip(w, ks)) for ks in itertools.permutations(range(m), n))
        assert p5_names._matched(w) == pytest.approx(most)


def test_p5_frequent_names_miss_no_link(spark):
    rng = random.Random(6)
    topics = ["Quantised Gesture Interfaces", "Dynamic Traffic Shaping", "Elastic Anomaly Tracing", "Bounded Robot Theory", "Interoperabilisation of Streaming Data", "Sparse Query Engines"]
    names = {"Dugirifefako QGI", "DTSI (Dugirifefako)", "EAT Dugirifefako"}
    for place in ["Dugirifefako"] * 3 + ["Roputu Vatelo"]:  # in far more than 25 readings
        for topic in topics:
            name = f"{place} {topic}"
            names |= {name, f"Journal of {topic}, {place} Institute", name.rsplit(" ", 1)[0], f"{name[:4]}. {topic}"}
            for _ in range(4):  # slips, doubled, dropped and exchanged letters
                i, j = sorted(rng.sample(range(1, len(name) - 2), 2))
                names.add(name[:i] + name[i + 1] + name[i] + name[i + 2 : j] + rng.choice("xyz") + name[j + 1 :])
                names.add(name[:i] + name[i:j] + name[j + 1 :])
                names.add(name[:i] + name[i] + name[i:])
    _, distinct = p5_names.readings(spark.createDataFrame(list(enumerate(sorted(names))), "entry_id long, journal_name string"))
    rows = sorted((r.id, r.reading) for r in distinct.collect())
    want = {(i, j) for i, x in rows for j, y in rows if i < j and p5_names.name_similarity(x, y) >= p5_names.LINK_AT}
    assert {(r.a, r.b) for r in p5_names.links(distinct).collect()} == want


def test_p5_cut_leaves_no_shuffle_files(spark):
    kept = lambda: sum(f.getName().startswith("shuffle_") for f in files(blocks.getAllFiles()))
    files, blocks = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    was, plan = kept(), spark.range(1000).repartition(4, "id").groupBy(F.col("id") % 7).count()
    session.cut(plan)
    for _ in range(50):  # they are removed in the background
        if kept() <= was:
            break
        time.sleep(0.2)
    assert kept() <= was


def test_p5_similar_words_over_small_batches(spark):
    words = {w[:n] for w in ("momepakumode", "modelling", "monitoring", "mobility") for n in range(2, 12)} | {"momepakumdoe", "modeling", "a" * 20, "a" * 18 + "b"}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        got = {tuple(r) for r in p5_names.similar_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()}
    finally:
        spark.conf.set(size, was)
    assert got == {(x, y) for x in words for y in words if p5_names.word_similarity((x, True), (y, True)) > 0}


def test_p5_similar_words_equal_brute_force(spark):
    rng = random.Random(7)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 18))) for _ in range(250)} | {"interoperabilisation", "interoperabilization", "interoperabilisatoin", "interop", "nteroperabilisaton"}
    got = p5_names.similar_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(x, y) for x in words for y in words if p5_names.word_similarity((x, True), (y, True)) > 0}


# 6
def test_p6_matches(spark):
    v = spark.createDataFrame(
        [("j1", "Annals of Graph Mining", "Alpha Press", "https://www.alphapress.example/agm"), ("j1", "ANNALS OF GRAPH MINING", None, None), ("j2", "Annals of Graph Mining", "Betamax Verlag", "https://www.betamax.example/agm"), ("j3", None, "Alpha Press", None), (None, "x", "y", "z")],
        "journal_id string, journal_name string, publisher string, homepage_url string",
    )
    rows = [(1, "Ann. of Graph Mining", "The Betamax Verlag GmbH", None), (2, "annals of graph mining (Online)", None, "http://alphapress.example/agm#scope"), (3, "Letters in Other Things", "Alpha Press", None),
            (4, None, None, None), (5, "", "", ""), (6, "Annals of Graph Mining", "Gammaray House", "https://www.gammaray.example/agm")]
    l = spark.createDataFrame(rows, "listing_id long, journal_name string, publisher string, homepage_url string").withColumn("name", F.lit("clash"))  # noqa: E741
    got = p6_link.matches(l, v).collect()
    assert {(r.listing_id, r.journal_id) for r in got} == {(1, "j2"), (2, "j1")} and all(0.5 <= r.confidence <= 1 for r in got)
    assert p6_link.matches(l.limit(0), v).count() == 0


def test_p6_neighbours_decide(spark):
    """Listings that name only a publisher, venues that have only a host: what their owners' other venues say, and nothing else, tells them apart."""
    v = [(f"j{i}", f"Annals of {w} Graph Mining", "Alpha Press", "https://www.northhouse.example/x") for i, w in enumerate(("Elastic", "Bounded", "Sparse", "Robust"))]
    v += [(f"k{i}", f"Letters in {w} Traffic Shaping", "Betamax Verlag", "https://www.southhouse.example/x") for i, w in enumerate(("Elastic", "Bounded", "Sparse", "Robust"))]
    v += [("a", "Journal of Packet Routing", None, "https://www.northhouse.example/jpr"), ("b", "Journal of Packet Routing", None, "https://www.southhouse.example/jpr"), ("c", "Journal of Image Theory", None, "https://www.southhouse.example/jit")]
    rows = [(i, n, p, None) for i, (_, n, p, _) in enumerate(v[:8])]
    rows += [(20, "Journal of Packet Routing", "Betamax Verlag", None), (21, "Journal of Packet Routing", "Alpha Press", None), (22, "Journal of Image Theory", "Alpha Press", None)]
    schema = "journal_name string, publisher string, homepage_url string"
    venues, listings = spark.createDataFrame(v, f"journal_id string, {schema}"), spark.createDataFrame(rows, f"listing_id long, {schema}")
    got = {(r.listing_id, r.journal_id) for r in p6_link.matches(listings, venues).collect()}
    assert {x for x in got if x[0] >= 20} == {(20, "b"), (21, "a")}  # 22 has the name of a venue of another house
    alone = {(r.listing_id, r.journal_id) for r in p6_link.matches(listings, venues, rounds=0).collect()}
    assert {x for x in alone if x[0] >= 20} == {(20, "a"), (21, "a"), (22, "c")}


def test_p6_frequent_keys_open_edges(spark, monkeypatch):
    v = spark.createDataFrame([(f"j{i}", f"Graph Mining Theory {w}", None, None) for i, w in enumerate(("Dasete", "Kilito", "Nemeke", "Roputu", "Vatelo"))], "journal_id string, journal_name string, publisher string, homepage_url string")
    l = spark.createDataFrame([(1, "Graph Mining Theory", None, None), (2, "Graph Mining Theory Roputu", None, None)], "listing_id long, journal_name string, publisher string, homepage_url string")  # noqa: E741
    monkeypatch.setattr(p6_link, "OVERSIZED", 2)  # each pair of words is held by more venues
    got = p6_link.candidate_edges(p6_link.attributes(l, "listing_id"), p6_link.attributes(v, "journal_id")).collect()
    assert {(r.listing_id, r.journal_id) for r in got} >= {(1, f"j{i}") for i in range(5)} | {(2, "j3")} and len(got) == len(set(got))


def test_p6_candidates_against_brute_force(spark):
    """Every pair of names that would be compared as alike, by all pairs, is a candidate for at least nine of ten."""
    rng = random.Random(11)
    topics = ["Graph Mining", "Traffic Shaping", "Anomaly Tracing", "Robot Theory", "Query Engines", "Image Synthesis"]
    venues, rows = [], []
    for i in range(90):
        name = f"{rng.choice(['Annals of', 'Journal of', 'Letters in'])} {rng.choice(['Elastic', 'Bounded', 'Sparse', 'Robust', 'Dynamic'])} {rng.choice(topics)}"
        house = f"{rng.choice(['alpha', 'betamax', 'gammaray'])}press"
        venues.append((f"j{i}", name, house.title(), f"https://www.{house}.example/v{i}"))
        for k in range(2):
            j = rng.randrange(1, len(name) - 1)
            slip = rng.choice([name[:j] + name[j + 1 :], name[:j] + name[j + 1] + name[j] + name[j + 2 :], name.upper(), f"The {name} (Online)"])
            rows.append((2 * i + k, slip, house.title() if k else None, None))
    schema = "journal_name string, publisher string, homepage_url string"
    v = p6_link.attributes(spark.createDataFrame(venues, f"journal_id string, {schema}"), "journal_id")
    l = p6_link.attributes(spark.createDataFrame(rows, f"listing_id long, {schema}"), "listing_id")  # noqa: E741
    want = {(a.listing_id, b.journal_id) for a in l.collect() for b in v.collect() if p5_names.name_similarity(a.name, b.name) >= p6_link.SURE}
    got = {(r.listing_id, r.journal_id) for r in p6_link.candidate_edges(l, v).collect()}
    assert len(want) > 180 and len(want & got) >= 0.9 * len(want)


@pytest.mark.filterwarnings("error:confidence is not stable")
def test_p6_leaves_few_tables(spark, monkeypatch):
    left, write, drop = set(), p6_link.cut, session.remove
    monkeypatch.setattr(p6_link, "cut", lambda df, after=(): (out := write(df, after), left.add(out.folder))[0])
    monkeypatch.setattr(session, "remove", lambda s, folder: (left.discard(folder), drop(s, folder))[1])
    fields = "journal_name string, publisher string, homepage_url string"
    v = spark.createDataFrame([("v", "Journal of Robust Graph Mining", "Aster Press", "https://www.aster.org/jrgm")], "journal_id string, " + fields)
    assert p6_link.matches(spark.createDataFrame([(1, "J. Robust Graph Mining", "Aster", None)], "listing_id long, " + fields), v, rounds=1).count() == 1
    assert len(left) == 2  # the edges, and the owners of the one round


def test_p6_says_when_confidence_is_not_stable(spark, monkeypatch):
    names = [f"Annals of {a} {b} Graph Mining" for a in ("Elastic", "Bounded", "Sparse") for b in ("Robot", "Query")]
    v = spark.createDataFrame([(f"j{i}", n, "Alpha Press", f"https://www.alphapress.example/p{i}x") for i, n in enumerate(names)], "journal_id string, journal_name string, publisher string, homepage_url string")
    l = spark.createDataFrame([(i, n, "Gammaray House", f"https://www.alphapress.example/p{i}x" if i % 2 else None) for i, n in enumerate(names)], "listing_id long, journal_name string, publisher string, homepage_url string")  # noqa: E741
    assert p6_link.matches(l, v).count() == len(names)
    monkeypatch.setattr(p6_link, "ROUNDS", 1)
    with pytest.warns(RuntimeWarning, match="not stable after 1 rounds"):
        p6_link.matches(l, v)


# 7
def test_p7_configurations_cover_demand():
    rng = random.Random(4)
    for _ in range(10):
        sizes = sorted(rng.sample(range(20, 100), 6))
        demand = [rng.randint(1, 40) for _ in sizes]
        plan = p7_pack.configurations(sizes, demand, 100)
        assert all(sum(c * s for c, s in zip(col, sizes)) <= 100 for col, _ in plan)
        assert [sum(col[i] * n for col, n in plan) for i in range(6)] == demand


def test_p7_packs(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.choice([1, 5, 20, 60, 150])))) for i in range(200)] + [(500, None), (501, ""), (1, "again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bin", F.lit(0)).dropDuplicates(["doc_id"])
    specs = spark.createDataFrame([(1, 64), (2, 256), (3, None), (4, 0)], "spec_id long, capacity_tokens int")
    out = p7_pack.assigned(d, specs).cache()
    bins = out.groupBy("spec_id", "bin").agg(F.sum("n_tokens").alias("z"))
    assert bins.where("z > case spec_id when 1 then 64 else 256 end").count() == 0
    whole = p7_pack.with_tokens(d, ["doc_id"]).agg(F.sum("n_tokens")).first()[0]
    assert {r.spec_id: r.t for r in out.groupBy("spec_id").agg(F.sum("n_tokens").alias("t")).collect()} == {1: whole, 2: whole}
    assert out.where("piece > 1 and spec_id = 2").count() == 0 or out.where("spec_id = 2").agg(F.max("piece")).first()[0] > 1
    assert all(r.fill > 0.85 for r in p7_pack.fill_report(out, specs).collect())
    assert p7_pack.assigned(d.limit(0), specs).count() == 0


# 8
def test_p8_mixture(spark):
    docs = [(i, "word " * (1 + i % 30), ["big", "big", "mid", "small"][i % 4] if i % 40 else "small") for i in range(400)] + [(900, None, "big"), (901, "x", None), (902, "", "mid")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("uses", F.lit(7))
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, None), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    drawn, plan = p8_mix.mixture(d, t)
    rep = {r.source: r for r in p8_mix.shares(drawn, plan).collect()}
    assert abs(rep["big"].actual_share - 0.5 / 0.9) < 0.02 and abs(rep["mid"].actual_share - 0.3 / 0.9) < 0.02 and rep["none"].drawn_docs == 0
    limits = {"big": 1, "mid": 2, "small": 1}
    assert all(r.uses <= limits[r.source] for r in drawn.collect())
    big, plan2 = p8_mix.mixture(d, t, 100_000)
    assert all(r.uses == limits[r.source] for r in big.collect())
    assert p8_mix.mixture(d.limit(0), t)[0].count() == 0


# 9
def test_p9_layout():
    text = "Aims and scope\nThe first sentence is here.\n\n- one item\n- another item\n\nA last line that is wrapped at\nsome width here."
    assert [text[a:b] for a, b in p9_sentences.units(text)][:4] == ["Aims and scope", "The first sentence is here.", "- one item", "- another item"]


def test_p9_sentences(spark):
    rng = random.Random(8)
    parts = ["Dr. Smith saw {} papers.", "The fee is 3.{} euros.", "Was it {} or more?", "We like the results, e.g. number {}, very much.", "Nobody objected in {}."]
    docs = []
    for i in range(150):
        paras = [" ".join(rng.choice(parts).format(rng.randint(10, 99)) for _ in range(rng.randint(1, 4))) for _ in range(3)]
        docs.append((i, "\n\n".join(paras)))
    docs += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "今日は晴れ。明日は雨！「本当ですか。」")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start_at", F.lit(1)).dropDuplicates(["doc_id"])
    texts = dict(docs)
    got = p9_sentences.sentences(d).collect()
    made = {}
    for r in got:
        s = texts[r.doc_id][r.start_at : r.end_at]
        assert s and s == s.strip()
        made.setdefault(r.doc_id, []).append(s)
    assert not {1000, 1001, 1002} & set(made)
    assert sorted(made[1003]) == ["「本当ですか。」", "今日は晴れ。", "明日は雨！"]
    right = sum(len(made[i]) == sum(texts[i].count(e) for e in ("papers.", "euros.", "more?", "much.", "objected in")) for i in range(1, 150))
    assert right >= 140
    assert p9_sentences.sentences(d.limit(0)).count() == 0


def test_light_keys_open_no_edges(spark, monkeypatch):
    """The edges kept are those of all shared keys, but the pairs that share only frequent ones are never written."""
    rng = random.Random(8)
    words = ["".join(rng.choices("bcdfgklmnprst", k=3)) + "ixo" for _ in range(60)]
    names = [f"Graph Mining {a} {b} Letters" for a, b in (rng.sample(words, 2) for _ in range(150))]
    schema = "journal_name string, publisher string, homepage_url string"
    v = p6_link.attributes(spark.createDataFrame([(f"v{i}", x, None, None) for i, x in enumerate(names)], f"journal_id string, {schema}"), "journal_id")
    l = p6_link.attributes(spark.createDataFrame([(i, x, None, None) for i, x in enumerate(names[:100] + ["Graph Mining"])], f"listing_id long, {schema}"), "listing_id")  # noqa: E741
    has = {r.journal_id: set(r["keys"]) for r in v.collect()}
    df = Counter(k for ks in has.values() for k in ks)
    want = set()
    for r in l.collect():
        weights = {j: sum(math.log((len(has) + 1) / df[k]) for k in sorted(set(r["keys"]) & ks)) for j, ks in has.items()}
        want |= {(r.listing_id, j) for j, w in weights.items() if w > 0 and w >= p6_link.KEEP * max(weights.values()) - 1e-9}
    rows, cut = [], p6_link.cut
    monkeypatch.setattr(p6_link, "cut", lambda df, *a, **k: rows.append((out := cut(df, *a, **k)).count()) or out)
    monkeypatch.setattr(p6_link, "RARE", 20)
    got = {(r.listing_id, r.journal_id) for r in p6_link.candidate_edges(l, v).collect()}
    assert got == want
    assert max(rows) < 5000  # all pairs are 15,150


def test_candidates_share_two_words_where_one_is_frequent(spark, monkeypatch):
    rng = random.Random(9)
    words = ("graph", "graphs", "mining", "minign", "packet", "routing", "visual", "tracking", "memory", "models")
    texts = sorted({" ".join(rng.sample(words, 2)) for _ in range(80)})
    distinct = spark.createDataFrame(list(enumerate(texts)), "id long, reading string")
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if p5_names.name_similarity(texts[a], texts[b]) >= p5_names.LINK_AT}
    monkeypatch.setattr(p5_names, "FEW", 5, raising=False)
    got = {(r.a, r.b) for r in p5_names.candidates(distinct).collect()}
    assert want and want <= got
    assert len(got) < 3 * len(want)  # by one word alone it is far more
