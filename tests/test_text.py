from pyspark.sql import functions as F

from folioforge.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


def test_clean_and_truncate(spark):
    assert one(spark, "  hello   world  ", tx.clean) == "hello world"
    assert one(spark, "hello\x00world", tx.clean) == "helloworld"
    assert one(spark, "hello world", lambda c: tx.truncate(c, 5)) == "hello..."
    assert one(spark, None, lambda c: tx.truncate(c, 5)) is None


def test_tokens_split_as_python(spark):
    for t in ["a b", "x　y z", " lead\x85trail ", "", None, "A\x1cB"]:
        assert one(spark, t, tx.tokens) == (t or "").lower().split()


def test_sentences(spark):
    assert one(spark, "一。二！\n three. still", tx.rough_sentences) == ["一", "二", "three. still"]


def test_overlap(spark):
    df = spark.createDataFrame([("the Big cat", "big CAT sat down", 2 / 4), ("", "abc", 0.0), (None, "abc", 0.0), ("an of", "an of", 0.0)], "a string, b string, x double")
    for r in df.select(tx.overlap(F.col("a"), F.col("b")).alias("y"), "x").collect():
        assert abs(r.y - r.x) < 1e-9


def test_indel_ratio_against_table(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
            row = new
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc"), ("journal of x", "jornal of xy"), ("é计", "计é计")]
    got = spark.createDataFrame(pairs, "a string, b string").select(tx.indel_ratio("a", "b").alias("r")).collect()
    assert [round(r.r, 9) for r in got] == [round(slow(a, b), 9) for a, b in pairs]


def test_token_budget(spark):
    assert one(spark, "计算机abcdefgh", tx.token_estimate) == 5
    assert one(spark, None, tx.token_estimate) == 0
    assert one(spark, "x", lambda c: tx.output_budget(F.length(c) * 199_000)) == 1500
