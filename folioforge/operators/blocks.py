"""A stated query set against all rows of a corpus, block by block, where no join key can carry the comparison."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: queries and corpus rows that meet in one task
QUERY_ROWS = 2_048
CORPUS_ROWS = 20_000


def spark_hash(number: int) -> int:
    """Spark's hash of an int column, by which rows find their shuffle partition."""
    mask = 0xFFFFFFFF

    def turned(x: int, by: int) -> int:
        return ((x << by) | (x >> (32 - by))) & mask

    k = turned(number * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h = (turned(42 ^ k, 13) * 5 + 0xE6546B64 & mask) ^ 4
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * by & mask
    return h - (1 << 32) if h >> 31 else h


def labels_apart(n: int, partitions: int) -> list[int]:
    """Numbers for ``n`` groups that spread them evenly over the shuffle's partitions; hashed as they are, several would share a task while others are idle."""
    held, labels, number = [0] * partitions, [], 0
    while len(labels) < n:
        at = spark_hash(number) % partitions
        if held[at] <= len(labels) // partitions:
            held[at] += 1
            labels.append(number)
        number += 1
    return labels


def in_blocks(
    queries: DataFrame, qkey: str, corpus: DataFrame, key: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    query_rows: int | None = None, corpus_rows: int | None = None,
) -> DataFrame:
    """``compare`` of every block of queries with every part of the corpus; each meeting is a group of its own.

    Blocks and parts are cut by the hash of the keys, which must be (nearly) unique, so that their sizes are
    bounded by the two row numbers, whatever the tables' sizes. Nothing is broadcast. ``compare`` should pass on
    only the best rows of each query; with an empty side it is not called for a meeting without queries or rows.
    """
    blocks, parts = max(1, -(-queries.count() // (query_rows or QUERY_ROWS))), max(1, -(-corpus.count() // (corpus_rows or CORPUS_ROWS)))
    wide = corpus.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, -(-(-(-blocks * parts // wide) * wide) // blocks))  # whole rounds of tasks
    spark = corpus.sparkSession
    labels = F.array(*[F.lit(x) for x in labels_apart(blocks * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))])

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(df: DataFrame) -> DataFrame:
        return df.withColumn("_m", F.get(labels, F.col("_b") * parts + F.col("_p"))).drop("_b", "_p")

    asked = met(queries.withColumn("_b", F.pmod(F.xxhash64(qkey), F.lit(blocks)).cast("int")).withColumn("_p", numbers(parts)))
    held = met(corpus.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("_b", numbers(blocks)))
    names = [c.split(":")[0].split()[0] for c in schema.split(",")]

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return compare(q, c) if len(q) and len(c) else pd.DataFrame(columns=names)

    return asked.groupBy("_m").cogroup(held.groupBy("_m")).applyInPandas(meet, schema)
