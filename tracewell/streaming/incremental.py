"""Incremental forms: new message rows to new distinct links, and appends that leave out what is already there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.dedupe import not_done
from tracewell.operators.links import valid_urls

#: Formats of message times that are read; others give null.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")


def message_time(c):
    """Timestamp of a message's time text, by the first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS))


def stream_links(messages: DataFrame, message: str, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Valid URLs of a message stream, each once.

    Without ``event_time`` the state holds every URL ever seen.  With it, a URL is dropped only within the watermark, which
    bounds the state; late rows beyond the delay are left out.
    """
    found = valid_urls(messages if event_time is None else messages.withWatermark(event_time, delay), message)
    return found.dropDuplicates(["url"]) if event_time is None else found.dropDuplicatesWithinWatermark(["url"])


def append_new(stream: DataFrame, key: str, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes each batch's rows whose key isn't yet in the Parquet table at ``path``; the check is below the transform, so that
    dear steps see new keys only.  A batch that is run again after a failure finds its own keys and adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = not_done(fresh, key, spark.read.parquet(path).select(key))
        transform(fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
