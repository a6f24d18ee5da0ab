"""JSON of captured pages: from responses and HTML to numbered, distinct canonical items of each page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import webjson
from tracewell.io import once
from tracewell.operators.dedupe import dense_numbers

#: Origins in the order in which a page's items are numbered.
RANK = {"har": 0, "html:server": 1, "html:dom": 2}


def response_items(df: DataFrame, page: str, entry: str, ctype: str, body: str) -> DataFrame:
    """(page, src, entry, pos, origin, payload) of response bodies.

    A JSON-like body that parses is ``har:json``, else what a JSONP call passes is ``har:jsonp``; an HTML-like body that gave
    neither is searched for scripts and literals, ``har:html``.  Blank bodies give nothing.
    """
    ct, b = F.col(ctype), F.col(body)
    rows = df.select(F.col(page).alias("page"), F.col(entry).alias("entry"), b.alias("b"), webjson.looks_like_json(ct, b).alias("j"), webjson.looks_like_html(ct, b).alias("h"), webjson.unwrap_jsonp(b).alias("p"))
    out = rows.select("page", "entry", F.posexplode(_items(F.col("j"), F.col("h"), F.col("b"), F.col("p"))).alias("pos", "i"))
    return out.select("page", F.lit(RANK["har"]).alias("src"), "entry", "pos", "i.origin", "i.payload")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("origin", T.StringType()), T.StructField("payload", T.StringType())])))
def _items(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Each body crosses to Python once."""
    for columns in batches:
        yield pd.Series([[{"origin": o, "payload": x} for o, x in webjson.response_items_of(*row)] for row in zip(*columns)], dtype=object)


def page_items(df: DataFrame, page: str, kind: str, html: str) -> DataFrame:
    """(page, src, entry, pos, origin, payload) of stored pages; ``kind`` is server or dom."""
    origin = F.concat(F.lit("html:"), F.col(kind))
    src = F.when(F.col(kind) == "server", RANK["html:server"]).otherwise(RANK["html:dom"])
    rows = df.select(F.col(page).alias("page"), src.alias("src"), F.lit(0).cast("long").alias("entry"), origin.alias("origin"), webjson.html_json(F.col(html)).alias("xs"))
    return rows.select("page", "src", "entry", F.posexplode("xs").alias("pos", "payload"), "origin").select("page", "src", "entry", "pos", "origin", "payload")


def number_items(items: DataFrame) -> DataFrame:
    """(page, item_no, origin, payload): each payload once per page, at its first place, numbered from 1 over the origins.

    ``items`` is written once.  Firsts and numbers are worked out on places and digests; payloads move one time, to their numbers.
    """
    at = F.struct("src", F.col("entry").cast("long").alias("entry"), "pos")
    kept = once(items.withColumn("digest", F.unhex(F.md5("payload"))).withColumn("size", F.char_length("payload")).withColumn("at", at))
    firsts = kept.groupBy("page", "digest", "size").agg(F.min("at").alias("at")).select("page", "at.src", "at.entry", "at.pos")
    numbers = dense_numbers(firsts, "page", ["src", "entry", "pos"]).select(F.col("page").alias("_page"), F.struct("src", "entry", "pos").alias("_at"), "item_no")
    return kept.join(numbers, F.col("page").eqNullSafe(F.col("_page")) & (F.col("at") == F.col("_at"))).select("page", "item_no", "origin", "payload")
