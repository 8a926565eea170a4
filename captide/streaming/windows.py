"""Event streams: windowed counts and sessions with late data."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captide.sources.shared import shared_folder


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n): counts per time window; events later than ``late`` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def session_counts(stream: DataFrame, gap: str = "75 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): sessions of a user's events that lie closer than ``gap``."""
    s = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that ``path`` (a file or a folder) holds now and later, at most ``files``
    of them in a batch."""
    batch = spark.read.parquet(path)
    folder, name = os.path.split(path)
    reader = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*" if os.path.isdir(path) else name)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path if os.path.isdir(path) else folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there, and returns what it has written. State and output lie in the
    shared folder that ``spark.checkpoint.dir`` names.

    With ``keys`` each batch writes the rows that it changed, and the last one of each key holds; without,
    a row is written once, when the watermark has passed it. Either way the watermark ends the state of
    what is over, and rows that come later than it allows are dropped."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
        written.append(batch)

    q = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    if not keys:
        return out.drop("batch")
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("x"))
    return last.select(*keys, "x.*").select(*stream.columns)
