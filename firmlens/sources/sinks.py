"""Writing results: exports of batches, CRM records and routed log events."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.sources.stored_days import merge_days


def write_sheet(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Flat sheet as CSV with a header, or as JSON, ORC or Parquet."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def batch_documents(items: DataFrame, summary: DataFrame, batch: str) -> DataFrame:
    """JSON lines of a batch export: one header line per batch, then one line per company.

    A batch is not gathered into one document, so its size is unlimited.
    """
    head = summary.select(batch, F.lit(0).alias("part"), F.lit(None).cast("long").alias("pos"),
                          F.to_json(F.struct(F.struct(*[c for c in summary.columns if c != batch]).alias("summary"))).alias("line"))
    rows = items.select(batch, F.lit(1).alias("part"), "pos", F.to_json(F.struct(
        F.col("company").alias("company_name"), "success", F.col("seconds").alias("processing_time"),
        F.when(F.col("success"), F.struct("industry", "company_size", "confidence")).alias("company_information"), "errors", "warnings")).alias("line"))
    return head.unionByName(rows)


def routed(events: DataFrame) -> DataFrame:
    """Each event once per kind of log it belongs to (all, errors, business), with its day."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("event_type") == "error", "errors"), F.when(F.col("event_type").isin("purchase", "signup"), "business")))
    return events.withColumn("kind", F.explode(kinds)).withColumn("day", F.to_date("ts"))


def route_events(events: DataFrame, folder: str) -> None:
    """All events, errors and business events by kind and day, in one pass; late rows join the rows their days hold, re-runs change nothing."""
    merge_days(routed(events), folder, ["event_id"], ["kind", "day"])


def route_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Streaming form of ``route_events``; a micro-batch is written under its number, so that a replay overwrites instead of adding."""
    def each(batch: DataFrame, batch_id: int) -> None:
        (routed(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "kind", "day").parquet(folder))
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
