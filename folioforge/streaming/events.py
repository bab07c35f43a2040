"""Progress of recommendations as an ordered table of events, and recommendation of papers that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: fixed values: the stages before the results, with their percentages
STAGES = (("parsing", 10), ("parsing", 20), ("quality", 22), ("quality", 25), ("retrieval", 25), ("retrieval", 50), ("ranking", 55), ("ranking", 65), ("ranking", 80), ("building", 85))


def progress(recommended: DataFrame) -> DataFrame:
    """(paper_id, seq, event, stage, percent): the stages, a recommendation and a progress event for each result, then done."""
    stages = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit("progress").alias("event"), F.lit(s).alias("stage"), F.lit(p).alias("percent")) for i, (s, p) in enumerate(STAGES)])
    papers = recommended.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    head = papers.select("paper_id", F.explode(stages).alias("e")).select("paper_id", "e.*")
    n = len(STAGES)
    ranked = recommended.join(papers, "paper_id")
    results = ranked.select("paper_id", (F.lit(n) + 2 * (F.col("rank") - 1)).alias("seq"), F.lit("recommendation").alias("event"), F.lit("building").alias("stage"), F.lit(None).cast("int").alias("percent"))
    steps = ranked.select(
        "paper_id", (F.lit(n + 1) + 2 * (F.col("rank") - 1)).alias("seq"), F.lit("progress").alias("event"), F.lit("building").alias("stage"),
        (F.lit(85) + F.floor((F.col("rank") - 1) * 10 / F.col("n"))).cast("int").alias("percent"),
    )
    done = papers.select("paper_id", (F.lit(n) + 2 * F.col("n")).alias("seq"), F.lit("done").alias("event"), F.lit("done").alias("stage"), F.lit(100).alias("percent"))
    out = head
    for part in (results, steps, done):
        out = out.unionByName(part.withColumn("seq", F.col("seq").cast("int")))
    return out


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """(…, no, event, data) of texts of event blocks between blank lines; blocks without a name or data are left out."""
    blocks = raw.select("*", F.posexplode(F.split(column, r"\n\n")).alias("no", "_b"))
    out = blocks.select("*", F.regexp_extract("_b", r"(?m)^event: *(.*)$", 1).alias("event"), F.regexp_extract("_b", r"(?m)^data: *(.*)$", 1).alias("data"))
    return out.where("event <> '' and data <> ''").drop("_b")


def recommend_stream(papers: DataFrame, recommend: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Recommends venues for streamed papers: each micro-batch is a plain batch job, written under its number.

    A batch that is tried again overwrites what it wrote, so the sink holds each batch once.
    """

    def run(batch: DataFrame, number: int) -> None:
        recommend(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return papers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
