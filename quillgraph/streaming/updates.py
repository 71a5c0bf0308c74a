"""Fleet and observation tables kept up to date from streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.analytics import fleet_merge


def arrivals(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keep_fleet(stream: DataFrame, into: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's merged identities to a table by batch; a repeated batch replaces itself."""

    def apply(batch: DataFrame, number: int) -> None:
        fleet_merge(batch).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fleet_so_far(spark: SparkSession, into: str) -> DataFrame:
    """One row an identity over all batches: the best claim, whether any host was seen running it, and where it was seen."""
    best = F.max_by(F.struct("name", "version", "tier", "confidence"), F.struct("tier", "confidence", -F.col("batch")))
    seen = F.sort_array(F.array_distinct(F.flatten(F.collect_list("seen_in"))))
    return spark.read.parquet(into).groupBy("identity").agg(best.alias("b"), F.bool_or("observed").alias("observed"), seen.alias("seen_in")).select("identity", "b.*", "observed", "seen_in")


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def first_observations(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (host, identity) once, however often it is seen within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["host", "identity"])
