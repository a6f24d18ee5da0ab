"""Expressions on captured responses: headers, content types, JSON and HTML."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import lstrip

# What a JSONP call, a data script, its CDATA marks and an assigned literal look like.
_JSONP = r"(?s)^\s*[a-zA-Z_$][\w$]*\s*\(\s*(\{.*\}|\[.*\])\s*\)\s*;?\s*$"
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.I | re.S)
_DATA_SCRIPT = re.compile(r"""type\s*=\s*["']\s*application/(?:ld\+json|json|manifest\+json)\s*["']|\bid\s*=\s*["']__NEXT_DATA__["']""", re.I)
_CDATA = re.compile(r"^\s*//\s*<!\[CDATA\[\s*|\s*//\s*\]\]>\s*$", re.M)
_ASSIGNED = re.compile(r"(?:(?<!\w)\w++\.[\w.$]++|(?:var|let|const)\s++[\w$]++)\s*+=\s*+(?=[{\[])", re.I | re.A)
#: Fixed value: characters at a body's beginning that are looked at for an HTML tag.
SNIFFED = 2_000
_CLOSED = {"{": re.compile(r"\}(?=\s*;)"), "[": re.compile(r"\](?=\s*;)")}


def header_map(headers: Column) -> Column:
    """Array of (name, value) structs to a map by lower-cased name; of repeated names the last holds; nameless are dropped."""
    named = F.filter(headers, lambda h: F.coalesce(h["name"], F.lit("")) != "")
    names = F.transform(named, lambda h: F.lower(h["name"]))
    keys = F.array_distinct(names)
    last = lambda k: F.element_at(F.filter(named, lambda h: F.lower(h["name"]) == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(last(k)["value"], F.lit(""))))


def content_type(mime: Column, headers: Column) -> Column:
    """The content's own type, else the header's, lower-cased; empty if neither says."""
    return F.lower(F.coalesce(F.nullif(mime, F.lit("")), F.element_at(headers, F.lit("content-type")), F.lit("")))


def charset(ctype: Column) -> Column:
    """First charset parameter after the type, without quotes; empty if there is none."""
    return F.regexp_extract(F.coalesce(ctype, F.lit("")), r"(?i);\s*charset=\s*[\"']?([^;\"']*?)[\"']?\s*(?:;|$)", 1)


def unwrap_jsonp(body: Column) -> Column:
    """The object or array that a JSONP call passes; empty if the body isn't such a call."""
    return F.regexp_extract(body, _JSONP, 1)


def looks_like_json(ctype: Column, body: Column) -> Column:
    """Whether the type says JSON, or the body's first character that isn't white space opens an object or array."""
    head = F.left(lstrip(body), F.lit(1))
    return F.coalesce(F.lower(ctype).contains("json"), F.lit(False)) | F.coalesce(head.isin("{", "["), F.lit(False))


def looks_like_html(ctype: Column, body: Column) -> Column:
    """Whether the type says HTML, or the body without its white space shows an HTML tag in its first SNIFFED characters."""
    head = F.lower(F.left(lstrip(body), F.lit(SNIFFED)))
    return F.coalesce(F.lower(ctype).contains("text/html"), F.lit(False)) | F.coalesce(head.startswith("<!doctype html") | head.contains("<html"), F.lit(False))


def fast_json_key(c: Column) -> Column:
    """Sorted minified JSON by Spark's variant, as a key: 1.0 becomes 1, and what variant can't read (repeated names) is null."""
    return F.to_json(F.try_parse_json(c))


def canonical(text: str | None) -> str | None:
    """Sorted minified JSON, numbers as written in Python, of repeated names the last; null if it isn't JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode("utf-8", "replace").decode("utf-8")
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([canonical(x) for x in s], dtype=object)


def script_json_of(html: str | None) -> list[str]:
    """Canonical JSON of the data scripts of a page, in order."""
    codes = (strip_cdata(m[2]) for m in _SCRIPT.finditer(html or "") if _DATA_SCRIPT.search(m[1]))
    return [c for c in map(canonical, codes) if c is not None]


def strip_cdata(code: str) -> str:
    return _CDATA.sub("", code).strip()


def inline_json_of(html: str | None) -> list[str]:
    """Canonical JSON of the literals assigned in a page; a literal ends at its first closing bracket before a semicolon.

    Closing brackets are looked up in a list of their places, so that a page of many assignments is read once.
    """
    text = html or ""
    out: list[str] = []
    ends: dict[str, list[int]] = {}
    at = 0
    for m in _ASSIGNED.finditer(text):
        if m.start() < at:
            continue
        kind = text[m.end()]
        if kind not in ends:
            ends[kind] = [x.end() for x in _CLOSED[kind].finditer(text)]
        i = bisect_right(ends[kind], m.end() + 1)
        if i < len(ends[kind]):
            at = ends[kind][i]
            if (value := canonical(text[m.end() : at])) is not None:
                out.append(value)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Data scripts, then assigned literals."""
    for s in batches:
        yield pd.Series([[*script_json_of(x), *inline_json_of(x)] for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def script_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([script_json_of(x) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def inline_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([inline_json_of(x) for x in s], dtype=object)


def response_items_of(jsonish: bool, htmlish: bool, body: str, jsonp: str) -> list[tuple[str, str]]:
    """(origin, canonical JSON) of one response body: itself, else what its JSONP call passes, else what its page holds."""
    if jsonish and (direct := canonical(body)) is not None:
        return [("har:json", direct)]
    if jsonp and (wrapped := canonical(jsonp)) is not None:
        return [("har:jsonp", wrapped)]
    return [("har:html", x) for x in (*script_json_of(body), *inline_json_of(body))] if htmlish else []
