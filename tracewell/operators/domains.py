"""Domain tables: Top-N with the rest, popularity ranks, and the mapping kept by surviving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import urls
from tracewell.functions.text import strip
from tracewell.io import fresh
from tracewell.operators.dedupe import spread_join
from tracewell.sources.files import resolve_columns


def top_n_with_others(df: DataFrame, key: str, n: int = 10, others: str = "Others") -> DataFrame:
    """(key, count, percentage) of the n most frequent non-empty keys, and a row for the rest if there is one.

    Ties go by key.  Percentages are of all non-empty rows, rounded half up to two places.  No rows give no rows.  Counting
    combines before its shuffle; the ranking sees one row per key and keeps the first n of each task before they meet.
    """
    counts = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc(key)).limit(n).withColumnRenamed("count", "c")
    total = counts.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("keys"))
    kept = top.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("c"))).alias("rows"), F.sum("c").alias("s"))  # n rows
    rest = F.when(F.col("total") > F.col("s"), F.array(F.struct(F.lit(others).alias("k"), (F.col("total") - F.col("s")).alias("c")))).otherwise(F.array())
    every = total.crossJoin(kept).filter("total > 0")  # one row each
    return every.select(F.explode(F.concat("rows", rest)).alias("r"), "total").select(
        F.col("r.k").alias(key), F.col("r.c").alias("count"), F.round(F.col("r.c") * F.lit(100.0) / F.col("total"), 2).alias("percentage"))


def domain_table(df: DataFrame, url: str, mode: str = "default") -> DataFrame:
    """(url, domain) of every row with a URL; nulls are left out."""
    u = urls.normalise_url(F.col(url), mode)
    return df.filter(F.col(url).isNotNull()).select(F.col(url).alias("url"), urls.registered_domain(u).alias("domain"))


def suffix_domain(df: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """(url, domain) by a table of public suffixes (column ``suffix``): the longest suffix of the host and one label more.

    An equi join of the host's own endings, at most as many as it has labels; hosts without a listed suffix keep two labels.
    """
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(url).alias("url"))
    rows = rows.withColumn("_host", urls.host(urls.normalise_url(F.col("url"))))
    labels = F.split("_host", r"\.")
    ends = rows.select("_row", "url", "_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: i)).alias("_k"))
    ends = ends.withColumn("_end", F.array_join(F.slice(F.split("_host", r"\."), -F.col("_k"), F.col("_k")), "."))
    hit = ends.join(suffixes.select(F.lower("suffix").alias("_end")).distinct(), "_end").groupBy("_row").agg(F.max("_k").alias("_k"))
    out = rows.join(hit, "_row", "left")
    take = F.least(F.coalesce(F.col("_k"), F.lit(1)) + 1, F.size(labels))
    plain = urls.registered_domain(urls.normalise_url(F.col("url")))
    return out.select("url", F.when(F.col("_k").isNull(), plain).otherwise(F.array_join(F.slice(labels, -take, take), ".")).alias("domain"))


def rank_table(df: DataFrame, rank: str, domain: str, order: str) -> DataFrame:
    """(domain lower-cased, tranco_rank): of repeated domains the last in ``order`` holds."""
    rows = df.select(F.lower(F.col(domain)).alias("domain"), F.col(rank).alias("r"), F.col(order).alias("o"))
    return rows.groupBy("domain").agg(F.max_by("r", "o").alias("tranco_rank"))


def with_rank(df: DataFrame, url: str, ranks: DataFrame) -> DataFrame:
    """``df`` with ``normalized_domain`` and ``tranco_rank``; every row stays, unmatched and null domains with null rank.

    Columns of ``df`` with these names give way.  The rank list may have a million domains: no broadcast is forced, Spark takes one when the list is under its threshold.
    A domain that most rows have is spread over tasks.
    """
    own = df.drop("tranco_rank").withColumn("normalized_domain", urls.netloc(F.col(url)))
    return spread_join(own, ["normalized_domain"], ranks.withColumnRenamed("domain", "normalized_domain"), df.drop("tranco_rank").columns)


def ranked_domains(df: DataFrame, url: str, ranks: DataFrame) -> DataFrame:
    """(domain, tranco_rank): distinct non-empty domains, sorted."""
    own = df.select(urls.netloc(F.col(url)).alias("domain")).filter("domain <> ''").distinct()
    return own.join(ranks, "domain", "left").select("domain", "tranco_rank").orderBy("domain")


def keep_surviving(mapping: DataFrame, files: DataFrame, row: str, hash_col: str = "hash") -> DataFrame:
    """Rows of ``mapping`` whose hash names a file of ``files`` (column ``name``): as stem, as whole name, or by its own stem.

    The three-way condition becomes equi joins on (kind, value) candidates; ``row`` must be unique.  Blank hashes match nothing.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    keys = files.select(F.explode(F.array(F.struct(F.lit("stem").alias("kind"), stem(F.col("name")).alias("value")), F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")))).alias("k")).select("k.*").distinct()
    h = strip(F.col(hash_col))
    tries = F.array_distinct(F.array(F.struct(F.lit("stem").alias("kind"), h.alias("value")), F.struct(F.lit("name").alias("kind"), h.alias("value")), F.struct(F.lit("stem").alias("kind"), stem(h).alias("value"))))
    cand = mapping.filter(h != "").select(F.col(row).alias("_row"), F.explode(tries).alias("k")).select("_row", "k.*")
    name = fresh(mapping, "_row")
    hits = cand.join(keys, ["kind", "value"], "left_semi").select(F.col("_row").alias(name)).distinct()
    return mapping.join(hits, F.col(row) == F.col(name), "left_semi")


def is_mapped(status: str = "status", strict: bool = False):
    """Whether a mapping row's status is mapped; unless strict in any letter case and with white space around.

    Null for null, which a filter drops: the strict form is a plain comparison, so that it reaches the scan.
    """
    c = F.col(status)
    return (c if strict else F.lower(strip(c))) == "mapped"


def surviving_domain_summary(mapping: DataFrame, files: DataFrame, row: str, n: int = 10, mode: str = "default") -> DataFrame:
    """Top-N of the domains of mapped rows that still have a file; URLs that are null drop out."""
    kept = keep_surviving(resolve_columns(mapping, keep=[row]).filter(is_mapped()), files, row)
    return top_n_with_others(domain_table(kept, "orig_url", mode), "domain", n)


def chart_table(summary: DataFrame, key: str) -> DataFrame:
    """(key, count, percentage, label): a summary with labels such as ``72.69%``; an empty one stays an empty table."""
    return summary.select(key, "count", "percentage", F.format_string("%.2f%%", "percentage").alias("label"))
