"""Classification by an external model: prompts, replay of recorded answers, a rule stub, chunked texts, resume and routing.

A model is any function from (key, prompt) rows to (key, raw, finish_reason, api_error) rows.  No network client is shipped.  Its
answers are written once to the checkpoint folder, so a model is never asked twice for what later steps read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import chunk_starts, nonblank, strip, truncate
from tracewell.io import fresh, once
from tracewell.operators import labels
from tracewell.operators.dedupe import not_done

CHUNK, OVERLAP = 50_000, 50
Model = Callable[[DataFrame], DataFrame]
TEMPLATE = "Vocabulary: {labels}\nName the user's own data of the vocabulary that the text below holds.\nAnswer Y,{{label,label}} or N,{{}}.\n\nTEXT:\n{text}\n\nAnswer:"


def prompts(df: DataFrame, key: str, text: str, vocabulary: Sequence[str] = labels.PII_TYPES, most: int | None = None, template: str = TEMPLATE) -> DataFrame:
    """(key, prompt): the template around each stripped text, cut to ``most`` characters if given; null texts are empty."""
    head, tail = template.replace("{labels}", ", ".join(vocabulary)).replace("{{", "{").replace("}}", "}").split("{text}")
    body = F.coalesce(F.col(text), F.lit(""))
    body = truncate(body, most) if most else strip(body)
    return df.select(F.col(key), F.concat(F.lit(head), body, F.lit(tail)).alias("prompt"))


def cluster_prompt(words: DataFrame, template: str = "Cluster the {n} keywords under ## headers with - bullets, each exactly once:\n{words}\n") -> DataFrame:
    """One row, ``prompt``, of an ordered keyword list (keyword, ord); the list is a vocabulary, not data that grows."""
    rows = words.agg(F.array_sort(F.collect_list(F.struct("ord", "keyword"))).alias("l"))
    a, b = template.split("{n}")
    b, c = b.split("{words}")
    return rows.select(F.concat(F.lit(a), F.size("l").cast("string"), F.lit(b), F.array_join(F.transform("l", lambda x: x["keyword"]), "\n"), F.lit(c)).alias("prompt"))


def replay(answers: DataFrame, key: str = "key") -> Model:
    """A model that looks up recorded answers (key, raw, finish_reason, api_error)."""

    def run(asked: DataFrame) -> DataFrame:
        return asked.select(key).join(answers.select(key, "raw", "finish_reason", "api_error"), key, "left")

    return run


#: Patterns of the rule stub, with the label each stands for.
RULES = (
    ("user's email address", r"(?i)[a-z0-9._%+-]@[a-z0-9-]+(?:\.[a-z0-9-]+)+"),
    ("user's social security number", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("user's telephone number", r"\+\d{8,15}\b|\(\d{3}\) ?\d{3}-\d{4}"),
    ("user's credit card number", r"\b(?:\d{4}[ -]){3}\d{4}\b"),
)


def rules(key: str = "key", table: Sequence[tuple[str, str]] = RULES) -> Model:
    """A deterministic model: labels whose pattern occurs after the prompt's ``TEXT:``."""

    def run(asked: DataFrame) -> DataFrame:
        text = F.substring_index("prompt", "\nTEXT:\n", -1)
        hits = F.array_compact(F.array(*(F.when(text.rlike(r), F.lit(label)) for label, r in table)))
        none = F.lit(None).cast("string")
        return asked.select(key, labels.result_of(hits).alias("raw"), F.lit("stop").alias("finish_reason"), none.alias("api_error"))

    return run


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index from 1, start, chars, chunk): fixed chunks; empty and null texts give none."""
    rows = df.select(F.col(key), F.col(text).alias("_t"), F.posexplode(chunk_starts(F.char_length(F.col(text)), size, overlap)).alias("_i", "start"))
    piece = F.substring(F.col("_t"), F.col("start") + 1, F.lit(size))
    return rows.select(key, (F.col("_i") + 1).alias("chunk_index"), "start", F.char_length(piece).alias("chars"), piece.alias("chunk"))


def classify_texts(df: DataFrame, key: str, text: str, model: Model, most: int = 25_000) -> DataFrame:
    """(key, raw, finish_reason, api_error, result, categories, parse_status): one call per text; an error of the call is its status.

    Answers are put onto the vocabulary row by row, so a repeated key stays as often as the model answers it.
    """
    answers = once(model(prompts(df, key, text, most=most))).withColumn("_n", labels.normalised(F.col("raw")))
    status = F.when(F.col("api_error").isNotNull(), "api_error").otherwise(F.col("_n.parse_status"))
    return answers.select(key, "raw", "finish_reason", "api_error", labels.result_of(F.col("_n.categories")).alias("result"), F.col("_n.categories").alias("categories"), status.alias("parse_status"))


def union_of_chunks(df: DataFrame, key: str, chunk_index: str, categories: str) -> DataFrame:
    """(key, categories, result) of chunk rows: the union by first place; keys whose chunks have none give ``N,{}``."""
    seen = df.select(key, chunk_index, F.posexplode(categories).alias("pos", "label"))
    cats = labels.first_seen(seen, key, [chunk_index, "pos"], "label").withColumnRenamed("values", "categories")
    out = df.select(key).distinct().join(cats, key, "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    return out.withColumn("result", labels.result_of(F.col("categories")))


def chunk_meta(df: DataFrame, key: str) -> DataFrame:
    """(key, num_chunks, chunk_outputs) of chunk rows (chunk_index, chars, parse_status, raw)."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chars", "parse_status", "raw"))).alias("chunk_outputs"))
    return rows.select(key, F.size("chunk_outputs").alias("num_chunks"), "chunk_outputs")


def classify_logs(df: DataFrame, key: str, text: str, model_for: Callable[[str], Model], *done: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, result, categories, parse_status, chunked, num_chunks, first_attempt_error) of the keys that are in none of ``done``.

    Texts up to ``size`` take one call; longer ones, and those whose call fails for their length, one per chunk.  Other failed
    calls are recorded with status ``api_error``.  ``model_for`` gives the model for a key column's name.  Blank and null texts give
    no row.  Short texts that share a key stay a row each; chunks of one key are one log.

    Answers carry their keys, so nothing is joined to a text; of a chunk's key (key#number) the log and place are read back.  Texts
    are read for the short ones, for the long ones, and by key for those that failed for their length.
    """
    todo = not_done(df.filter(nonblank(F.col(text))), key, *done).select(key, text)
    none = F.lit(None).cast("string").alias("first_attempt_error")
    first = classify_texts(todo.filter(F.char_length(text) <= size), key, text, model_for(key), most=size)
    failed = F.coalesce(F.lower("api_error").contains("context") | F.lower("api_error").contains("overflow"), F.lit(False))
    one = first.filter(~failed).select(key, "result", "categories", "parse_status", F.lit(False).alias("chunked"), F.lit(1).alias("num_chunks"), none)
    retry = first.filter(failed).groupBy(key).agg(F.max("api_error").alias("first_attempt_error"))
    long = todo.filter(F.char_length(text) > size).unionByName(todo.join(retry.select(key), key, "left_semi"))
    call = fresh(df, "chunk_key")
    parts = chunks(long, key, text, size, overlap).select(F.concat_ws("#", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias(call), "chunk")
    said = once(model_for(call)(prompts(parts, call, "chunk"))).select(
        F.regexp_extract(call, r"(?s)^(.*)#\d+$", 1).cast(df.schema[key].dataType).alias(key), F.regexp_extract(call, r"(\d+)$", 1).cast("int").alias("i"), labels.normalised(F.col("raw")).alias("n"))
    # a log's chunks come together with their labels, never with their texts
    lists = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("n.categories").alias("c")))), lambda x: x["c"])
    many = said.groupBy(key).agg(F.array_distinct(F.flatten(lists)).alias("categories"), F.count_distinct("i").cast("int").alias("num_chunks")).join(retry, key, "left")
    return one.unionByName(many.select(key, labels.result_of(F.col("categories")).alias("result"), "categories", F.lit("chunked").alias("parse_status"), F.lit(True).alias("chunked"), "num_chunks", "first_attempt_error"))


def route(results: DataFrame, files: DataFrame, name: str, result: str = "result") -> DataFrame:
    """(file_name, bucket, missing): the image of each result, in bucket pii where the result begins with Y, else no_pii.

    A ``.txt`` name stands for the ``.png`` of the same stem; results without a file are missing.
    """
    target = F.regexp_replace(strip(F.col(name)), r"\.txt$", ".png")
    rows = results.select(target.alias("file_name"), F.when(strip(F.col(result)).startswith("Y"), "pii").otherwise("no_pii").alias("bucket"))
    there = files.select(F.col("name").alias("file_name"), F.lit(False).alias("_no")).distinct()
    return rows.join(there, "file_name", "left").select("file_name", "bucket", F.col("_no").isNull().alias("missing"))
