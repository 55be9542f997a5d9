"""Reads that land in a folder as Parquet: classified and counted as they come, each file once.

The stateless part is the batch code itself. Daily counts use an event-time window and a watermark, so late
rows are taken for as long as the watermark permits and state is dropped after it; the sink is a Parquet table
whose checkpoint makes a restart after a lost executor or driver go on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reads


def classify_stream(rows: DataFrame, minlen: int, maxlen: int) -> DataFrame:
    """Adds the first failed filter to every read, batch or stream."""
    return rows.withColumn("case", reads.single_end_case("seq_", "qual_", F.lit(minlen), F.lit(maxlen)))


def daily_counts(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Per run, day of loading and case the number of reads; a read delivered again within the watermark counts once."""
    marked = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["run_id", "read_id"])
    return marked.groupBy(F.window("loaded_at", "1 day").alias("day"), "run_id", "case").agg(F.count("*").alias("reads")).select(F.col("day.start").alias("day"), "run_id", "case", "reads")


def ingest(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, *, minlen: int, maxlen: int, late: str = "2 days") -> StreamingQuery:  # noqa: ANN001
    """Take in everything that has landed so far and stop (for a scheduler); days are written once the watermark has passed."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(landing)
    counts = daily_counts(classify_stream(stream, minlen, maxlen), late)
    return counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
