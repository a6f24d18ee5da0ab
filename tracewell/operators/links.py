"""Links of messages: from message rows to one row per clean, valid, distinct URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import urls
from tracewell.operators.dedupe import first_by


def _others(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]


def found_urls(df: DataFrame, message: str) -> DataFrame:
    """Rows of ``df`` exploded to their URL texts: columns of ``df`` and ``pos`` (from 0), ``raw_url``, which replace columns so named."""
    return df.select(*_others(df, "pos", "raw_url"), F.posexplode(urls.find_urls(F.col(message))).alias("pos", "raw_url"))


def valid_urls(df: DataFrame, message: str) -> DataFrame:
    """Rows of ``df`` exploded to their clean, valid URLs: columns of ``df`` and ``pos`` (from 0 among all found), ``url``,
    which replace columns so named, the message's too.

    Cleaning stands inside the explode, so that filters and later steps read its result instead of working it out again.
    """
    cleaned = F.transform(urls.find_urls(F.col(message)), urls.clean_url)
    out = df.select(*_others(df, "pos", "url"), F.posexplode(cleaned).alias("pos", "url"))
    return out.filter(F.col("url").isNotNull() & urls.is_valid_url(F.col("url")))


def extract_urls(df: DataFrame, message: str, order: str) -> DataFrame:
    """One row per distinct valid URL: its first message in ``order``, and there its first place."""
    return first_by(valid_urls(df, message), ["url"], [order, "pos"])


def extraction_stats(df: DataFrame, message: str) -> DataFrame:
    """One row: messages with a URL text before cleaning, valid URLs, distinct valid URLs."""
    with_url = df.agg(F.count_if(F.size(urls.find_urls(F.col(message))) > 0).alias("messages_with_url"))
    per_url = valid_urls(df, message).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    totals = per_url.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid_urls"), F.count(F.lit(1)).alias("distinct_urls"))
    return with_url.crossJoin(totals)  # one row each
