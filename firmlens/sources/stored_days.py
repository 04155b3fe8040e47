"""Rows stored by day, rewritten by key: late rows join their day, replaced rows go, everything else stays."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.operators.durable import stored


def rows_of(spark: SparkSession, folder: str) -> DataFrame | None:
    """What a folder holds, or None if nothing was written yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge_days(rows: DataFrame, folder: str, key: list[str], days: list[str]) -> None:
    """Put ``rows`` into the days (or months) they belong to (columns ``days``); a row replaces the stored one of its key and day.

    Only the touched days are read and written. They are complete in a table of their own before any is
    replaced, so a run that stops half way is mended by running it again; running it twice changes nothing.
    Key columns must not be null.
    """
    arrived = stored(rows.dropDuplicates([*key, *days]), "arrived")
    old = rows_of(rows.sparkSession, folder)
    if old is not None:
        touched = old.join(arrived.select(*days).distinct(), days, "left_semi")
        arrived = stored(touched.join(arrived.select(*key, *days), [*key, *days], "left_anti").unionByName(arrived, allowMissingColumns=True), "merged")
    arrived.hint("rebalance", *days).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*days).parquet(folder)


def delivered(rows: DataFrame, number: int, folder: str, send=None) -> None:
    """One micro-batch for ``foreachBatch``: kept under its number and handed to ``send(rows, number)`` once.

    The ledger entry is written after ``send`` returned. A batch that is replayed with an entry is not sent again;
    one that stopped in between is sent again under the same number, by which the receiver can tell.
    """
    spark = rows.sparkSession
    kept = f"{folder}/rows/batch={number}"
    rows.write.mode("overwrite").parquet(kept)
    if send is None or rows_of(spark, f"{folder}/sent/batch={number}") is not None:
        return
    send(spark.read.schema(rows.schema).parquet(kept), number)
    spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")
