"""Reading and writing the catalogue, papers and results."""

from __future__ import annotations

import glob
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.tables import venue_profile

VENUE = (
    "journal_id string, journal_name string, publisher string, subject_tags array<string>, keywords array<string>, scope_text string, oa_type string, "
    "submission_url string, homepage_url string, sqr_rank int, quartile string, ccf_rating string, impact_like_score double, review_time string, "
    "apc double, target_paper_type array<string>, journal_profile string"
)
PAPER = "paper_id long, title string, abstract string, full_text string, mode string"
EVALUATION = "title string, abstract string, venue string, year int, ccf_level string, research_area array<string>, external_ids map<string,string>, pdf_url string, pdf_path string"


def _exists(path: str) -> bool:
    return "://" in path and not path.startswith("file:") or bool(glob.glob(path.removeprefix("file://"))) or os.path.exists(path.removeprefix("file://"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file. Strict: a bad line fails the job; else it is left out. A missing local path is empty."""
    if not _exists(path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue with ``pos`` in file order; the profile is always computed anew."""
    v = read_jsonl(spark, path, VENUE).withColumn("pos", F.monotonically_increasing_id())
    filled = v.withColumn("oa_type", F.coalesce("oa_type", F.lit("subscription"))).withColumn("scope_text", F.coalesce("scope_text", F.lit("")))
    return filled.withColumn("journal_profile", venue_profile())


def normalise_files(spark: SparkSession, paths: list[str], schema: str = VENUE, key: str = "journal_id") -> DataFrame:
    """Several files read tolerantly; of rows with one key the first in file order stays."""
    out = None
    for no, path in enumerate(paths):
        part = read_jsonl(spark, path, schema, strict=False).withColumn("_f", F.lit(no)).withColumn("_p", F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    w = Window.partitionBy(key).orderBy("_f", "_p")
    return out.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_f", "_p")


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """UTF-8 JSON lines; one file only where the order of lines matters and the data are small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """(key, embedding), joined by key and not by position."""
    df.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """None where there is no index; the vector route is then left out."""
    return spark.read.parquet(path) if _exists(path) else None


def _decode(content: pd.Series) -> pd.Series:
    def one(raw: bytes | None) -> str | None:
        for coding in ("utf-8", "gbk", "latin-1"):
            try:
                return None if raw is None else raw.decode(coding)
            except UnicodeDecodeError:
                pass
        return None

    return content.map(one)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else GBK (which Spark's own decode lacks), else Latin-1."""
    return F.pandas_udf(_decode, StringType())(content)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text and Markdown files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def directory_records(lines: DataFrame, doc: str = "doc", no: str = "line_no", text: str = "text") -> DataFrame:
    """(doc, rec, line): rows of a printed directory; lines are joined until one holds an address."""
    w = Window.partitionBy(doc).orderBy(no)
    ends = F.col(text).contains("http").cast("int")
    rec = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = lines.withColumn("rec", rec).groupBy(doc, "rec").agg(F.array_sort(F.collect_list(F.struct(no, text))).alias("p"))
    return grouped.select(doc, "rec", F.array_join(F.transform("p", lambda x: F.trim(x[text])), " ").alias("line"))


def directory_fields(record: DataFrame) -> DataFrame:
    """no, abbreviation, name, publisher and address of a directory row; rows of another form are left out."""
    form = r"^\s*(\d+)\s+(\S+)\s+(.+?)\s+(\S+)\s+(https?://\S+)"
    cols = [F.regexp_extract("line", form, i).alias(n) for i, n in enumerate(("no", "abbrev", "journal_name", "publisher", "url"), 1)]
    return record.where(F.col("line").rlike(form)).select("doc", "rec", *cols)


def doaj_venues(raw: DataFrame, column: str = "record") -> DataFrame:
    """Venues from raw records of an open-access directory: at most ten keywords; open access if either flag says so."""
    shape = (
        "id string, bibjson struct<title string, publisher struct<name string>, keywords array<string>, boai boolean, oa_start int, "
        "subject array<struct<code string, term string>>, ref struct<journal string, author_instructions string>>"
    )
    r = F.from_json(column, shape)
    return raw.select(r.alias("r")).where("r.id is not null").select(
        F.col("r.id").alias("journal_id"), F.col("r.bibjson.title").alias("journal_name"), F.col("r.bibjson.publisher.name").alias("publisher"),
        F.slice(F.coalesce("r.bibjson.keywords", F.array().cast("array<string>")), 1, 10).alias("keywords"), F.col("r.bibjson.subject.term").alias("subjects"),
        F.when(F.coalesce("r.bibjson.boai", F.lit(False)) | F.col("r.bibjson.oa_start").isNotNull(), "full_oa").otherwise("subscription").alias("oa_type"),
        F.col("r.bibjson.ref.journal").alias("homepage_url"),
    )


def write_results(df: DataFrame, path: str) -> None:
    """Evaluation results, one JSON object for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
