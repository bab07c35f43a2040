"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger is a folder of Parquet buckets (bucket, key, copies, first_line, first_seen) with a manifest that names
the folder of each bucket's newest state; whoever opens the folder, in this session or a later one, goes on from there.
A batch of lines is aggregated by canonical key before anything is shuffled, full-outer-joined with the buckets
that it touches, and those buckets are written anew; the others keep their files. The manifest is written last, so that
a batch counts wholly or not at all; states that no bucket needs any more are then removed. The number of buckets
follows the number of keys: when a bucket has more than ``BUCKET_KEYS`` on average, all are written anew in more buckets.

Two lines are copies if the letters and digits of their four values agree without regard to case. An absent
or null value equals an empty one. A line that is no JSON object, or has none of the four values, is compared
by the letters and digits of its whole text; a null record is a record with no letters. Repeated line_ids
count as one line (of several records the one with the smallest key). An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, lookup, scratch

FIELDS = ("journal_id", "journal_name", "publisher", "oa_type")
LEDGER = "bucket int, key string, copies long, first_line long, first_seen timestamp"
MANIFEST = "bucket int, folder string, n_keys long, n_buckets int"
#: buckets of a new ledger, and keys of a bucket from which on there are more
LEAST_BUCKETS, BUCKET_KEYS = 8, 2_000_000


def letters_digits(value: Column) -> Column:
    """Case folded, so that ``ß`` equals ``SS``; accents stay."""
    return F.replace(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{M}\p{N}]+", "")), F.lit("ß"), F.lit("ss"))


def canonical_key(record: Column) -> Column:
    parsed = F.from_json(record, ", ".join(f"{f} string" for f in FIELDS))
    key = F.concat_ws("|", *[letters_digits(parsed[f]) for f in FIELDS])
    return F.when(F.coalesce(*[parsed[f] for f in FIELDS]).isNull(), F.concat(F.lit("="), letters_digits(record))).otherwise(key)


def keyed_lines(lines: DataFrame) -> DataFrame:
    """(line_id, key, fetched_at), one row for each line_id. The records themselves are never shuffled."""
    keyed = lines.where("line_id is not null").select("line_id", canonical_key(F.col("record")).alias("key"), "fetched_at")
    return keyed.groupBy("line_id").agg(F.min(F.struct("key", "fetched_at")).alias("k")).select("line_id", "k.key", "k.fetched_at")


class Ledger:
    """The buckets below ``root``, opened where the newest manifest left them; ``root`` unset is a new ledger in the shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch(spark, "p4-ledger")).rstrip("/")
        self.places: dict[int, tuple[str, int]] = {}
        self.n_buckets, self.generation = LEAST_BUCKETS, 0
        done = [int(p.rpartition("-")[2]) for p in self._folders(f"{self.root}/manifest") if self._has(f"{p}/_SUCCESS")]
        if done:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/generation-{max(done)}").collect()  # a row for each bucket
            self.places = {r.bucket: (r.folder, r.n_keys) for r in rows if r.bucket >= 0}
            self.n_buckets, self.generation = rows[0].n_buckets, max(done) + 1

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        folders = [p for b, (p, _) in self.places.items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*folders)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.n_buckets)).cast("int")

    def fold(self, keyed: DataFrame) -> None:
        """Adds a batch of ``keyed_lines`` to the ledger."""
        new = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line"), F.min("fetched_at").alias("seen")))
        keys, wanted = new.count() + sum(n for _, n in self.places.values()), self.n_buckets
        while keys > wanted * BUCKET_KEYS:
            wanted *= 2
        regrouped, self.n_buckets = wanted != self.n_buckets, wanted
        bucketed = new.withColumn("bucket", self.bucket())
        # the numbers of the buckets, as many as the keys over BUCKET_KEYS
        touched = None if regrouped or not self.places else sorted(r[0] for r in bucketed.select("bucket").distinct().collect())
        old = self.read(touched).withColumn("bucket", self.bucket())
        merged = bucketed.join(old, ["bucket", "key"], "full_outer").select(
            "bucket",
            "key",
            (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
            F.least("first_line", "line").alias("first_line"),
            F.least("first_seen", "seen").alias("first_seen"),
        )
        folder = f"{self.root}/generation-{self.generation}"
        merged.withColumn("part", F.col("bucket")).repartition("part").write.partitionBy("part").parquet(folder)
        before = {p for p, _ in self.places.values()}
        sizes = self.spark.read.schema(f"{LEDGER}, part int").parquet(folder).groupBy("part").count().collect() if self._folders(folder) else []
        self.places = ({} if regrouped else self.places) | {r[0]: (f"{folder}/part={r[0]}", r[1]) for r in sizes}
        rows = [(b, p, n, self.n_buckets) for b, (p, n) in self.places.items()] or [(-1, "", 0, self.n_buckets)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/generation-{self.generation}")
        for gone in before - {p for p, _ in self.places.values()}:
            self._remove(gone)
        self._remove(f"{self.root}/manifest/generation-{self.generation - 1}")
        self._remove(new.folder)
        self.generation += 1

    def _path(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, file: str) -> bool:
        path, system = self._path(file)
        return system.exists(path)

    def _folders(self, folder: str) -> list[str]:
        path, system = self._path(folder)
        return [s.getPath().toString() for s in system.listStatus(path) if s.isDirectory()] if system.exists(path) else []

    def _remove(self, folder: str) -> None:
        path, system = self._path(folder)
        system.delete(path, True)


def batches(keyed: DataFrame, n: int) -> list[DataFrame]:
    """The lines as they would have arrived: ``n`` spans of ``fetched_at``, lines without one first."""
    at = F.unix_micros("fetched_at")
    cuts = keyed.select(F.percentile_approx(at, [i / n for i in range(1, n)], 1000)).first()[0] or []
    spans, rest = [], at.isNull() if cuts else F.lit(True)
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (at > low)
        if high is not None:
            inside = inside & (at <= high)
        spans.append(keyed.where(F.coalesce(inside, F.lit(False)) | (rest if low is None else F.lit(False))))
    return spans


def build_ledger(keyed: DataFrame, n_batches: int = 3, root: str | None = None) -> Ledger:
    ledger = Ledger(keyed.sparkSession, root)
    for batch in batches(keyed, n_batches):
        ledger.fold(batch)
    return ledger


def records(lines: DataFrame) -> DataFrame:
    """One row for each record: key, copies, first_line, first_seen."""
    return build_ledger(cut(keyed_lines(lines))).read().select("key", "copies", "first_line", "first_seen")


def copy_lines(lines: DataFrame) -> DataFrame:
    """(first_line, copy_line) for each line that is not its record's first. A key with a third of all lines never meets in one task."""
    keyed = cut(keyed_lines(lines))
    repeated = build_ledger(keyed).read().where("copies > 1").select("key", "first_line", "copies")
    met = lookup(keyed.select("key", F.col("line_id").alias("copy_line")), repeated, ["key"], "copies", keyed.count())
    return met.where("first_line <> copy_line").select("first_line", "copy_line")
