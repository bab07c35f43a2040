"""Session helpers: the shared folder for cut lineages, table loading and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a local session names none (tests), a fresh one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("folioforge.scratch", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("folioforge.scratch", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: has Spark remove the shuffle files of a statement when it ends, not when the driver happens to collect its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, after: Sequence[DataFrame] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that its plan and its loss are both short.

    ``after`` names tables of earlier cuts that nothing reads once this one is written; they are removed. The
    shuffle files of the writing are removed with its end.
    """
    path, conf = scratch(df.sparkSession, "cut"), df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)
    for old in after:
        remove(df.sparkSession, old.folder)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder that ``scratch`` named."""
    if not folder.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{folder} is not below the shared folder")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else ``df`` as it is (Spark then shuffles)."""
    few = df.select(F.lit(1)).limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


#: a key is hot if it holds over one row in so many; at most as many keys can be
HOT_ONE_IN = 1000


def lookup(facts: DataFrame, dim: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a table that has one row for each key and the number of its facts in ``count``.

    The hot keys, at most ``HOT_ONE_IN`` by construction, are looked up by broadcast, so that a key with a
    third of all facts never meets in one task; the others are joined by key. ``count`` is dropped. Null keys
    match nothing.
    """
    hot = dim.where(F.col(count) > total / HOT_ONE_IN).drop(count)
    cold = dim.where(F.col(count) <= total / HOT_ONE_IN).drop(count)
    marked = facts.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    return (
        marked.where("_hot").drop("_hot").join(F.broadcast(hot), keys)
        .unionByName(marked.where("_hot is null").drop("_hot").join(cold, keys))
    )


#: copies of the small side of ``spread_left``, and its rows up to which it is broadcast
SALTS, BROADCAST_ROWS = 8, 100_000


def is_small(dim: DataFrame) -> bool:
    most = max(BROADCAST_ROWS, 0)
    return dim.select(F.lit(1)).limit(most + 1).count() <= most


def spread_left(facts: DataFrame, dim: DataFrame, keys: list[str], by: str, small: bool | None = None) -> DataFrame:
    """Left join with a table that has one row for each key, in ``SALTS`` parts by the fact column ``by``.

    Facts with a null or empty key match nothing and are spread evenly. A table that is counted and found small (or
    known to be ``small``) is broadcast; otherwise it is copied for each part, being small beside the facts.
    """
    if is_small(dim) if small is None else small:
        return facts.join(F.broadcast(dim), keys, "left")
    known = F.lit(True)
    for k in keys:
        known = known & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    apart = F.when(known, F.lit("")).otherwise(F.col(by).cast("string"))
    salted = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).withColumn("_apart", F.lit(""))
    met = facts.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).withColumn("_apart", apart)
    return met.join(salted, [*keys, "_salt", "_apart"], "left").drop("_salt", "_apart")
