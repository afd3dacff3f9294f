"""The figures and the latest rows of a run while its logs grow, over a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..operators.summary import kept_runtime, kept_tokens, last_rows
from ..sources.shared import literal

KEYS = ("system_id", "page_id")


def follow(spark: SparkSession, folder: str, files_a_trigger: int | None = None) -> DataFrame:
    """Log rows of files as they arrive below folder/system_id=.../."""
    reader = spark.readStream.schema(schemas.ANY_LOG + ", line_no long, system_id string")
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.json(folder)


def running_results(rows: DataFrame) -> DataFrame:
    """sample_size, mean_runtime_ms, mean_output_tokens, reparse_rate by system so far; for complete or update mode.
    State is a row for each system.
    """
    flag = F.when(F.col("reparse_triggered").isNotNull(), F.col("reparse_triggered").cast("int"))
    return rows.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(kept_runtime()).alias("mean_runtime_ms"), F.avg(kept_tokens()).alias("mean_output_tokens"),
        F.avg(flag).alias("reparse_rate")
    )


def keep_latest(rows: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a log and keep the last row (by line_no) of each system and page, as it changes.

    State is a row a page, kept by key in the state store. Each batch writes the pages that changed to a folder of its
    own number, in place of what a failed attempt at the same batch may have left, so every change is there once.
    Of rows with equal numbers the first that arrived stays. latest() reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:09d}")

    return last_rows(rows, "line_no", *KEYS).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each page that keep_latest has written, whatever the batches were."""
    try:
        return last_rows(spark.read.parquet(literal(folder)), "line_no", *KEYS).drop("batch")
    except AnalysisException:  # nothing yet
        return spark.createDataFrame([], schemas.ANY_LOG + ", line_no long, system_id string")
