"""Sections of documents: from fonts of layout blocks, and from numbered lines of plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: how headings begin, and the sizes of their levels
HEADINGS = (
    "Introduction", "Related Work", "Background", "Preliminaries", "Method", "Methodology", "Approach", "Model", "Algorithm", "Experiment",
    "Experiments", "Evaluation", "Results", "Analysis", "Discussion", "Conclusion", "Conclusion and Future Work", "References", "Acknowledgment", "Appendix",
)
SIZES = (16.0, 13.0, 11.0)
#: fixed values: the lines that open a section, in the order in which they are tried
SECTIONS = (
    ("introduction", r"(?i)1\s*\.?\s*Introduction|1\s*引言|引\s*言"),
    ("method", r"(?i)2\s*\.?\s*(Proposed|Method|Approach)|2\s*方法|算法|技术"),
    ("experiment", r"(?i)3\s*\.?\s*(Experiment|Evaluation|Results)|3\s*实验|评估|结果"),
    ("conclusion", r"(?i)(Conclusion|Discussion|Summary)|结[论语]|总结"),
)


def heading_level(text: Column, size: Column) -> Column:
    """0 for text, else the level of the heading."""
    t = F.trim(text)
    named = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(h)) for h in HEADINGS])
    by_size = F.when(named & (size >= SIZES[0]), 1).when(named & (size >= SIZES[1]), 2).when(named & (size >= SIZES[2]), 3)
    return F.coalesce(by_size, F.when(t.rlike(r"^\d+\.\s+[A-Z]"), 2), F.when((size >= SIZES[0]) & (F.length(t) < 100), 1), F.lit(0))


def sections(blocks: DataFrame) -> DataFrame:
    """(paper_id, section_no, title, level, n_blocks, content): blocks from one heading to the next, in reading order.

    What precedes the first heading is the Preamble. A section's heading is one of its blocks but not part of
    its content. Blocks without a paper are left out.
    """
    w = Window.partitionBy("paper_id").orderBy("page", "y0", "x0", "block_id")
    marked = blocks.where("paper_id is not null").withColumn("level", heading_level(F.col("text"), F.col("font_size")))
    numbered = marked.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seq", F.row_number().over(w))
    grouped = numbered.groupBy("paper_id", "section_no").agg(
        F.max(F.when(F.col("level") > 0, F.trim("text"))).alias("title"), F.max("level").alias("level"), F.count(F.lit(1)).alias("n_blocks"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("seq", F.trim("text").alias("t"))))).alias("parts"),
    )
    content = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    return grouped.select("paper_id", F.col("section_no").cast("long").alias("section_no"), F.coalesce("title", F.lit("Preamble")).alias("title"), F.greatest("level", F.lit(1)).alias("level"), "n_blocks", content.alias("content"))


#: fixed values: the titles of an abstract
ABSTRACTS = ("Abstract", "摘要")


def lifted(section: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paper_id, abstract), and the sections without it: a first section that is titled as an abstract is none of the sections."""
    first = section.groupBy("paper_id").agg(F.min_by(F.struct("section_no", "title", "content"), "section_no").alias("f"))
    found = first.where(F.col("f.title").isin(*ABSTRACTS)).select("paper_id", F.col("f.section_no").alias("section_no"), F.col("f.content").alias("abstract"))
    return found.select("paper_id", "abstract"), section.join(found, ["paper_id", "section_no"], "left_anti")


def markdown(section: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, markdown): the title, the abstract, and the sections under headings of their level."""
    body = section.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "level", "title", "content"))).alias("s"))
    parts = F.transform("s", lambda x: F.concat(F.repeat(F.lit("#"), F.least(x["level"] + 1, F.lit(6))), F.lit(" "), x["title"], F.lit("\n"), x["content"]))
    head = F.filter(F.array(F.concat(F.lit("# "), "title"), F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(F.lit("## Abstract\n"), "abstract"))), lambda x: x.isNotNull())
    return body.join(papers.select("paper_id", "title", "abstract"), "paper_id").select("paper_id", F.array_join(F.concat(head, parts), "\n").alias("markdown"))


def text_sections(papers: DataFrame, key: str = "paper_id", text: str = "full_text") -> DataFrame:
    """(key, section, content): lines under the last heading pattern that a line held; short lines and number pairs are dropped."""
    line = F.trim(F.regexp_replace(F.col("raw"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    lines = papers.select(key, F.posexplode(F.split(text, "\n")).alias("no", "raw")).withColumn("line", line).where("line <> ''")
    found = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in SECTIONS])
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.coalesce(F.last(found, ignorenulls=True).over(w), F.lit("other")))
    kept = placed.where((F.length("line") >= 10) & ~F.col("line").rlike(r"^\d+\s+\d+$"))
    return kept.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ").alias("content"))
