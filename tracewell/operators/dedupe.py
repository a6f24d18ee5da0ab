"""First-wins de-duplication, incremental filters and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.io import fresh, once


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in ``order``; nulls are a key like any other, and come first in an order.

    An aggregate, not a window: each task keeps one row of a key before the shuffle, so a hot key moves one row per task.  Rows
    equal in ``order`` are told apart by their other columns where these can be ordered.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = fresh(df, "_row")
    sortable = [f.name for f in df.schema if f.name not in order and f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    ordering = F.struct(*(F.col(f"`{c}`") for c in [*order, *sortable]))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), ordering).alias(row))
    return best.select(*keys, *(F.col(f"{row}.`{c}`").alias(c) for c in rest)).select(*(F.col(f"`{c}`") for c in df.columns))


#: Parts of a hot key's rows.
SALTS = 64


def spread_join(df: DataFrame, keys: Sequence[str], lookup: DataFrame, by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """``df`` left-joined with ``lookup`` (unique ``keys``, nulls equal) where one key may hold a third of the rows of ``df``.

    Rows are salted by a hash of ``by``, which should tell a key's rows apart.  The distinct (key, salt) pairs, at most ``salts`` of
    a key and combined before their shuffle, fetch the lookup's columns; rows then join the pairs by key and salt, so a hot key's
    rows lie in many tasks and no row of the lookup is copied without need.
    """
    salt, mine = fresh(df, "_salt"), [f"_k{i}" for i in range(len(keys))]
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in by)), F.lit(salts)).cast("int"))
    named = lookup.select(*(F.col(f"`{k}`").alias(m) for k, m in zip(keys, mine)), *(c for c in lookup.columns if c not in keys))
    pairs = salted.select(*(F.col(f"`{k}`").alias(f"_p{m}") for k, m in zip(keys, mine)), F.col(salt).alias("_ps")).distinct()
    known = pairs.join(named, _all(F.col(f"_p{m}").eqNullSafe(F.col(m)) for m in mine), "left").drop(*mine)
    on = _all([*(F.col(f"`{k}`").eqNullSafe(F.col(f"_p{m}")) for k, m in zip(keys, mine)), F.col(salt) == F.col("_ps")])
    return salted.join(known, on, "left").drop(salt, "_ps", *(f"_p{m}" for m in mine))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def content_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest, survivor, is_duplicate): which earlier key holds the same content.  Null contents are one content.

    Contents are read once for their digests; a content that a third of all rows have (the empty one, say) is spread over tasks.
    """
    rows = df.select(F.col(key).alias("key"), F.md5(F.coalesce(F.col(content).cast("binary"), F.lit(b""))).alias("digest"), F.col(content).isNull().alias("void"))
    kept = rows.groupBy("digest", "void").agg(F.min("key").alias("survivor"))
    out = spread_join(rows, ["digest", "void"], kept, ["key"])
    return out.select(F.col("key").alias(key), "digest", "survivor", (F.col("key") != F.col("survivor")).alias("is_duplicate"))


def crawl_status(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with ``crawl_status``: mapped for the first row of each key in ``order``, skipped for later ones.

    Null is a key like any other.  Rows that tie for the first are all mapped.  A column ``crawl_status`` of ``df`` is replaced.
    """
    first = fresh(df, "_first")
    firsts = df.groupBy(key).agg(F.min(order).alias(first))
    out = spread_join(df, [key], firsts, [order])
    return out.withColumn("crawl_status", F.when(F.col(order) == F.col(first), "mapped").otherwise("skipped")).drop(first)


def not_done(df: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in none of ``done`` (first column of each); rows with a null key stay."""
    name, keys = fresh(df, "_done"), None
    for d in done:
        one = d.select(F.col(d.columns[0]).alias(name))
        keys = one if keys is None else keys.unionByName(one)
    return df if keys is None else df.join(keys.distinct(), F.col(key) == F.col(name), "left_anti")


def union_by_position(first: DataFrame, *others: DataFrame, strict: bool = False) -> DataFrame:
    """All rows of all tables under the first table's header; short rows are padded with null, long ones cut, all as text."""
    width = len(first.columns)
    out = first.select([F.col(f"`{c}`").cast("string").alias(c) for c in first.columns])
    for df in others:
        if strict and len(df.columns) != width:
            raise ValueError(f"{len(df.columns)} columns under a header of {width}")
        given: list[Column] = [F.col(f"`{c}`").cast("string") for c in df.columns[:width]]
        given += [F.lit(None).cast("string")] * (width - len(given))
        out = out.unionAll(df.select([c.alias(n) for c, n in zip(given, first.columns)]))
    return out


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, ord): each value once with its first place."""
    return df.groupBy(value).agg(F.min(order).alias("ord"))


def dense_numbers(df: DataFrame, group: str, order: Sequence[str], name: str = "item_no") -> DataFrame:
    """``df`` with numbers from 1 inside each group, in ``order``, which must tell a group's rows apart.

    Rows are cut into ranges of (group, order), so a group that holds a third of all rows lies in many ranges.  Numbers are ranks
    inside a range plus the counts of the group's earlier ranges.  The ranges are written once, as both readings must see the same.
    """
    part, first, rank = fresh(df, "_part"), fresh(df, "_first"), fresh(df, "_rank")
    cut = once(df.repartitionByRange(group, *order).withColumn(part, F.spark_partition_id()))
    sizes = cut.groupBy(group, part).agg(F.count(F.lit(1)).alias(rank))
    starts = sizes.select(F.col(group).alias("_g"), F.col(part).alias("_p"), (F.sum(rank).over(Window.partitionBy(group).orderBy(part)) - F.col(rank)).alias(first))
    ranked = cut.withColumn(rank, F.row_number().over(Window.partitionBy(group, part).orderBy(*order)))
    out = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col(part) == F.col("_p")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(rank) + F.col(first)).cast("int").alias(name))
