"""Streams: rate limiting, request metrics and incremental indexing over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT, SECONDS = 60, 60


def sliding_hits(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Adds hits: the user's requests in the minute up to and including each one; requests a full minute old no longer count."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(user).orderBy("at_").rangeBetween(-SECONDS * 1_000_000 + 1, 0)
    return events.withColumn("at_", at).withColumn("hits", F.count("*").over(w)).drop("at_")


def reset_limiter(events: DataFrame, limit: int = LIMIT, user: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """(user, event, hits, rejected): the window also resets as a whole a minute after it began, and rejected hits count.

    State runs from hit to hit, so this is a grouped function; a user's rows come in order, in one Arrow batch.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", event])
        began, hits, out = None, [], []
        for u, e, t in zip(rows[user], rows[event], rows["at"], strict=True):
            if began is None or t - began >= SECONDS * 1_000_000:
                began, hits = t, []
            hits = [h for h in hits if t - h < SECONDS * 1_000_000]
            hits.append(t)
            out.append((u, e, len(hits), len(hits) > limit))
        return pd.DataFrame(out, columns=[user, event, "hits", "rejected"])

    slim = events.select(user, event, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return slim.groupBy(user).applyInPandas(run, f"{user} long, {event} long, hits int, rejected boolean")


def event_stream(spark: SparkSession, folder: str, names: str = "*.parquet") -> DataFrame:
    """The event files of a folder as a stream, with an event-time watermark. Times without a zone are read as the session's."""
    schema = spark.read.parquet(f"{folder}/{names}").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", "16").option("pathGlobFilter", names).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def windowed_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what there is into a memory table of that name, for small results."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def index_stream(stream: DataFrame, sync: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch goes through ``sync`` with its id; with an ``IndexLog`` a replayed batch gives the same index."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sync).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The Parquet files at a path, a file or a folder, as a stream of micro-batches of some files."""
    schema = spark.read.parquet(path).schema
    # As a pattern, since a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(f"{path[:-1]}[{path[-1]}]")


#: Kinds of files that can be uploaded, and why others are refused.
UPLOADS = ("txt", "docx", "pdf")
UNSUPPORTED, TOO_LARGE = "unsupported_type", "too_large"


def refusal(cap: int) -> Column:
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return F.when(~ext.isin(*UPLOADS), UNSUPPORTED).when(F.col("length") > cap, TOO_LARGE)


def upload_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, cap: int = 20 << 20):
    """Files that arrive in a folder: ``out/accepted`` gets path, ext, length, modificationTime and content, ``out/refused`` a reason.

    A refused file's bytes are not read: the reason is a matter of its name and length. Each micro-batch writes its own two
    folders anew, so a batch that is replayed after a failure leaves one row for each file. Spark's file readers pass over
    files without bytes: these give no row.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = raw.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "64").load(folder)

    def both(files: DataFrame, batch: int) -> None:
        reason = refusal(cap)
        ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext")
        refused = files.select("path", "length", "modificationTime", ext, reason.alias("reason")).where("reason is not null")
        refused.write.mode("overwrite").parquet(f"{out}/refused/batch={batch}")
        # Length is a filter of its own, so that the reader skips the bytes of files beyond the cap.
        small = files.where(F.col("length") <= cap).where(reason.isNull())
        small.select("path", ext, "length", "modificationTime", "content").write.mode("overwrite").parquet(f"{out}/accepted/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both).trigger(availableNow=True).start()


def request_metrics(events: DataFrame) -> DataFrame:
    """Per event type: requests, summed and largest value, and the value of the latest event."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"), F.max_by("value", F.struct("ts", "event_id")).alias("latest")
    )


def exposition(metrics: DataFrame) -> DataFrame:
    """One text line for each counter, in the usual exposition format."""
    return metrics.select(F.format_string('requests_total{event_type="%s"} %d', "event_type", "requests").alias("line"))
