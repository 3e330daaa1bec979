"""Traces as a stream: each new (context, module) pair is appended once to a table of observed imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depweave.schema import TRACE
from depweave.session import exists

OBSERVED = "context string, module string"


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet trace files as they arrive."""
    return spark.readStream.schema(TRACE).parquet(folder)


def observed(trace: DataFrame) -> DataFrame:
    """Pairs worth keeping, of a stream or a table."""
    return trace.where((F.col("status") == "ok") & ~F.coalesce("is_ignored", F.lit(False))).select("context", "module")


def append_new(pairs: DataFrame, out: str) -> None:
    """Appends the pairs that the table lacks. Done twice it appends nothing, so a batch may be repeated."""
    spark = pairs.sparkSession
    stored = spark.read.schema(OBSERVED).parquet(out) if exists(spark, out) else spark.createDataFrame([], OBSERVED)
    pairs.distinct().join(stored, ["context", "module"], "left_anti").write.mode("append").parquet(out)


def start(trace: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = observed(trace).writeStream.foreachBatch(lambda batch, _: append_new(batch, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
