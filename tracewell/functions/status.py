"""Statuses of captures: their classes, and the one that a page keeps of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import strip

#: Fixed value: the partial capture that no later partial one replaces.
SERVER_PARTIAL = "partial-server-html"


def status_class(status: Column) -> Column:
    """The word that a status begins with, in small letters (ok, skipped, partial, error ...); empty for others, null for null."""
    return F.regexp_extract(F.lower(strip(status)), "^[a-z]+", 0)


def final_status(df: DataFrame, page: str, status: str, order: str, server: str = SERVER_PARTIAL) -> DataFrame:
    """(page, status) that each page keeps: the last in ``order``, but a server-HTML partial stays over later partial ones.

    A later status of another class (ok, error) replaces it.  Null statuses are no statement.  Of rows equal in ``order`` the
    greater status holds.  An aggregate of two candidates of each page: a hot page is combined before its shuffle.
    """
    s = F.lower(strip(F.col(status)))
    rows = df.select(F.col(page).alias("page"), s.alias("s"), F.struct(F.col(order).alias("o"), s.alias("s")).alias("at")).filter("s is not null and s <> ''")
    partial, from_server = status_class(F.col("s")) == "partial", F.col("s").startswith(server)
    kept = rows.groupBy("page").agg(
        F.max("at").alias("last"), F.max(F.when(from_server, F.col("at"))).alias("first"), F.max(F.when(~partial, F.col("at"))).alias("whole"))
    holds = F.col("first").isNotNull() & (status_class(F.col("last.s")) == "partial") & F.coalesce(F.col("whole") < F.col("first"), F.lit(True))
    return kept.select(F.col("page").alias(page), F.when(holds, F.col("first.s")).otherwise(F.col("last.s")).alias("status"))
