"""Readers and writers of text, CSV, image, HAR and log files, and column checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import SPACE, strip
from tracewell.io import fresh


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header, quotes doubled, line breaks inside quotes; all text.  Named columns that are missing are empty.

    With line breaks a file can't be cut, so it is one task; without ``multi_line`` large files are read in parts.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', quote='"')
    if columns is None:
        return df
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def by_position(df: DataFrame, index: int, name: str) -> DataFrame:
    """One column by its place from 0; rows too short for it (null) are left out."""
    return df.select(F.col(f"`{df.columns[index]}`").alias(name)).filter(F.col(name).isNotNull())


def resolve_columns(df: DataFrame, names: Sequence[str] = ("orig_url", "hash", "status"), places: Sequence[int] = (0, 2, 3), keep: Sequence[str] = ()) -> DataFrame:
    """``names`` by name if all are there, else by place; ValueError if there are too few columns."""
    if all(n in df.columns for n in names):
        picked = [F.col(f"`{n}`") for n in names]
    elif len(df.columns) > max(places):
        picked = [F.col(f"`{df.columns[i]}`").alias(n) for n, i in zip(names, places)]
    else:
        raise ValueError(f"need columns {list(names)} or at least {max(places) + 1} columns, got {df.columns}")
    return df.select(*picked, *(c for c in keep if c not in names))


def require_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): rows with a non-blank key, null texts empty; ValueError if a column is missing."""
    missing = [c for c in (key, text) if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(strip(F.col(key)).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text)).filter(F.coalesce(F.col(key), F.lit("")) != "")


def lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Stripped lines that aren't blank."""
    return df.select(strip(F.col(value)).alias(value)).filter(F.col(value) != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark.read.text(path))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A headerless ``rank,domain`` list with its order ``ord``; a row that doesn't fit fails the read."""
    return spark.read.schema("rank INT, domain STRING").csv(path, mode="FAILFAST").withColumn("ord", F.monotonically_increasing_id())


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A mapping of four fields that are all quoted, quotes doubled; other lines are dropped."""
    cell = '"((?:[^"]|"")*)"'
    row = "^" + ",".join([cell] * 4) + "$"
    raw = spark.read.text(path).filter(F.col("value").rlike(row))
    picked = [F.replace(F.regexp_extract("value", row, i), F.lit('""'), F.lit('"')).alias(n) for i, n in enumerate(("orig_url", "final_url", "hash", "status"), 1)]
    return raw.select(*picked).filter((F.col("orig_url") != "orig_url") | (F.col("hash") != "hash"))


def read_images(spark: SparkSession, root: str, extensions: Sequence[str] = (".png",), content: bool = True) -> DataFrame:
    """Files under ``root``, at any depth, with one of the extensions in any letter case; without ``content`` only names are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return df.filter(ends.isin([e.lower() for e in extensions])).select("path", "length", *(["content"] if content else []))


def with_names(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with ``name`` and ``stem``, the file's name with and without its extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return df.withColumn("name", name).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))


ARTIFACTS = (".har", ".server.html", ".dom.html")


def artifact_stems(df: DataFrame, name: str = "name") -> DataFrame:
    """(stem, n): stems of the names with one of the artifact suffixes, and how many of the suffixes each has; sorted."""
    stem = F.regexp_extract(F.col(name), r"^(.*?)(\.har|\.server\.html|\.dom\.html)$", 1)
    suffix = F.regexp_extract(F.col(name), r"^(.*?)(\.har|\.server\.html|\.dom\.html)$", 2)
    found = df.select(stem.alias("stem"), suffix.alias("suffix")).filter("stem <> ''")
    return found.groupBy("stem").agg(F.count_distinct("suffix").alias("n")).orderBy("stem")


def read_wholes(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of each file, bad bytes replaced; for HAR, HTML and log files."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def numbered_payloads(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, item_no, number, origin, payload) of texts made of items ``N [origin] payload``; blank payloads are dropped.

    A payload runs to the next header.  Texts without a header give no row.
    """
    item = r"(?s)(?:^|\n)[ \t]*(\d+)[ \t]*\[\s*([^\]\n]+?)\s*\][ \t]*(.*?)(?=\n[ \t]*\d+[ \t]*\[[^\]\n]+\]|\z)"
    get = lambda i: F.regexp_extract_all(F.col(text), F.lit(item), F.lit(i))
    out = df.select(F.col(key), F.posexplode(F.arrays_zip(get(1).alias("number"), get(2).alias("origin"), get(3).alias("payload"))).alias("pos", "x"))
    out = out.select(key, (F.col("pos") + 1).alias("item_no"), F.col("x.number").cast("int").alias("number"), F.col("x.origin").alias("origin"), strip(F.col("x.payload")).alias("payload"))
    return out.filter("payload <> ''")


def numbered_lines(df: DataFrame, key: str, item_no: str, origin: str, payload: str) -> DataFrame:
    """(key, item_no, line): the items as lines ``N [origin] payload`` of a key's log.

    A log stays a set of rows with their order: a key's rows needn't meet in one task.  ``write_per_key`` gives each key its folder.
    """
    line = F.concat(F.col(item_no).cast("string"), F.lit(" ["), F.col(origin), F.lit("] "), F.col(payload))
    return df.select(key, item_no, line.alias("line"))


def keywords(df: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, keyword, ord): keywords of texts, one a line, or parted by commas too if a comma occurs; each once, at its first place.

    Without ``keys`` the texts are one list; with them a list per key.  Null and blank texts have none.
    """
    sep = F.when(F.col(text).contains(","), F.lit(r"[,\n]+")).otherwise(F.lit(r"\n+"))
    parts = df.select(*keys, F.posexplode(F.split(F.col(text), sep)).alias("ord", "keyword"))
    parts = parts.select(*keys, strip(F.col("keyword")).alias("keyword"), "ord").filter("keyword <> ''")
    return parts.groupBy(*keys, "keyword").agg(F.min("ord").alias("ord"))


def clusters(df: DataFrame, text: str = "value") -> DataFrame:
    """(category, keyword, ord) of texts with ``## category`` headers and ``- keyword`` bullets under them."""
    texts = df.select(F.monotonically_increasing_id().alias("_text"), F.col(text).alias("_t"))
    rows = texts.select("_text", F.posexplode(F.split("_t", r"\r?\n")).alias("ord", "line"))
    head = F.regexp_extract("line", rf"^[{SPACE}]*##[{SPACE}]+(.+?)[{SPACE}]*$", 1)
    bullet = F.regexp_extract("line", rf"^[{SPACE}]*-[{SPACE}]+(.*[^{SPACE}])[{SPACE}]*$", 1)
    named = rows.select("_text", "ord", F.when(head != "", head).alias("head"), bullet.alias("keyword"))
    up_to = Window.partitionBy("_text").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return named.withColumn("category", F.last("head", ignorenulls=True).over(up_to)).filter("keyword <> ''").select("category", "keyword", "ord")


# Sinks


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quote_all: bool = False) -> None:
    """CSV with a header, also for no rows; nulls are empty fields; ``quote_all`` quotes every field, quotes doubled."""
    df.write.csv(path, header=True, mode=mode, escape='"', emptyValue='""' if quote_all else "", nullValue="", quoteAll=quote_all,
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_sorted_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct values, one a line, in code point order over the part files' names."""
    df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Rows added to a results table in Parquet (no header to repeat)."""
    df.write.mode("append").parquet(path)


HEADER = "part-header.csv"


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV text without headers; the header stands once, in a file of its own, written when it is new.

    Fields are written as ``write_csv`` writes them.  ValueError where the header that is there names other columns.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path, HEADER)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns)
    if fs.exists(at):
        there = spark.read.text(at.toString(), wholetext=True).first()[0].rstrip("\n")
        if there != names:
            raise ValueError(f"the file has the columns {there}, not {names}")
    df.write.csv(path, header=False, mode="append", escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not fs.exists(at):
        out = fs.create(at, True)
        out.write(bytearray((names + "\n").encode()))
        out.close()


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_csv`` wrote, all text."""
    names = spark.read.csv(f"{path}/{HEADER}", header=True, escape='"').columns
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("pathGlobFilter", "part-[0-9]*").csv(path, multiLine=True, escape='"', quote='"')


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_per_key(df: DataFrame, key: str, path: str, buckets: int | None = None) -> None:
    """Rows of each key together; keys without rows have none.

    A folder per key suits some thousand keys.  With ``buckets`` the folders are that many ranges of the key's hash, sorted by key
    inside, so that a key's rows are found by its bucket however many keys there are; a key with very many rows fills several files.
    """
    if buckets is None:
        df.write.mode("overwrite").partitionBy(key).parquet(path)
        return
    name = fresh(df, "bucket")
    rows = df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartitionByRange(F.col(name), F.col(key), F.xxhash64(*df.columns)).sortWithinPartitions(name, key).write.mode("overwrite").partitionBy(name).parquet(path)


def with_destination(df: DataFrame, path: str = "path", order: str = "path") -> DataFrame:
    """``df`` with ``dest_name`` (name without folders), ``n_same`` files of that name, and ``wins`` for the last in order.

    Columns of ``df`` with these names give way.
    """
    last = fresh(df, "_last")
    out = df.drop("n_same", "wins").withColumn("dest_name", F.element_at(F.split(path, "/"), -1))
    per = out.groupBy("dest_name").agg(F.count(F.lit(1)).alias("n_same"), F.max(order).alias(last))
    return out.join(per, "dest_name").withColumn("wins", F.col(order) == F.col(last)).drop(last)


def copy_files(df: DataFrame, source: str, folder: Column, target_root: str) -> None:
    """Copies each row's file (a local or mounted path) to ``target_root``/``folder``; the executors copy."""

    def copy(rows) -> None:
        import os
        import shutil

        for r in rows:
            os.makedirs(os.path.join(target_root, r["folder"]), exist_ok=True)
            shutil.copy2(r["source"].removeprefix("file:"), os.path.join(target_root, r["folder"]))

    df.select(F.col(source).alias("source"), folder.alias("folder")).foreachPartition(copy)
