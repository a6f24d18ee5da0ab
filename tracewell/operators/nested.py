"""Nested JSON documents into flat tables that keep parent and child links.

Every node of a document gets a Dewey label: the ordinals (from 1) on the way from the root, joined by dots, zero-padded so
that text order is document order.  A node's schema path is the same way with names instead of ordinals (``[]`` for array
items).  Nodes of equal schema path form one table; a row's parent is found by cutting its own label, never by a join.

One narrow pass reads each document once and emits only the nodes of the wanted tables, so nothing is shuffled and a document
is never gathered with others.  The longest document bounds the memory of a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of an ordinal in a label: text order is document order up to ten thousand million items of one parent.
WIDTH = 10
NODE_SCHEMA = "schema_path string, dewey string, kind string, value string, scalars map<string,string>"


def _reject(name: str) -> None:
    raise ValueError(name)


def parse_json(text: str | None) -> tuple[bool, object]:
    """Whether the text is valid JSON, and its value.  Null, blank, cut off, with a tail, or NaN: not valid."""
    if text is None or not text.strip():
        return False, None
    try:
        return True, json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return False, None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass
class _Wanted:
    """Trie of the wanted schema paths, so that a walk leaves out branches without wanted nodes."""

    here: bool = False
    next: dict[str, "_Wanted"] = field(default_factory=dict)

    def add(self, steps: list[str]) -> None:
        if steps:
            self.next.setdefault(steps[0], _Wanted()).add(steps[1:])
        else:
            self.here = True


def _steps(path: str) -> list[str]:
    return [s for part in path.split(".") if part for s in ([part[:-2], "[]"] if part.endswith("[]") and part != "[]" else [part])]


def _kind(value: object) -> str:
    return {dict: "object", list: "array", type(None): "null", str: "string", bool: "boolean"}.get(type(value), "number")


def _walk(value: object, wanted: _Wanted, path: str, label: str) -> Iterator[tuple]:
    stack = [(value, wanted, path, label)]
    while stack:
        value, wanted, path, label = stack.pop()
        if wanted.here:
            if isinstance(value, dict):
                scalars = {k: _text(v) for k, v in value.items() if not isinstance(v, (dict, list))}
                yield path, label, "object", None, scalars
            else:
                yield path, label, _kind(value), None if isinstance(value, list) else _text(value), None
        if isinstance(value, dict):
            below = []
            for no, (name, child) in enumerate(value.items(), 1):
                # "{}" stands for any member name: objects used as maps
                for step in (name, "{}"):
                    if step in wanted.next:
                        below.append((child, wanted.next[step], f"{path}.{step}", f"{label}.{no:0{WIDTH}d}", name))
            for child, to, at, lab, name in reversed(below):
                if at.endswith(".{}") and to.here:
                    child = {"name": name, "value": child}
                stack.append((child, to, at, lab))
        elif isinstance(value, list) and "[]" in wanted.next:
            to = wanted.next["[]"]
            stack.extend((child, to, f"{path}[]", f"{label}.{no:0{WIDTH}d}") for no, child in reversed(list(enumerate(value, 1))))


def _wanted(paths: list[str]) -> _Wanted:
    root = _Wanted()
    for p in paths:
        if not p.startswith("$"):
            raise ValueError(f"a path starts at $: {p}")
        root.add(_steps(p[1:].replace("[]", ".[]")))
    return root


def dewey_nodes(df: DataFrame, key: str, json_col: str, paths: list[str]) -> DataFrame:
    """Nodes of ``json_col`` at the wanted schema paths: (key, schema_path, dewey, kind, value, scalars).

    ``paths`` are written from the root ``$``, e.g. ``$.log.entries[]``; ``.{}`` takes every member of an object as
    a node with the scalars ``name`` and, where the member is scalar, ``value``.  The root's label is ``1``.  ``scalars`` has an object's own scalar
    members as text.  Null, blank and invalid JSON give no row; the extra columns of ``df`` aren't read.  Of repeated member
    names the last holds, at its first place.
    """
    root = _wanted(paths)

    def nodes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch[key], batch[json_col]):
                valid, value = parse_json(text)
                if valid:
                    rows.extend((k, *node) for node in _walk(value, root, "$", "1"))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=[key, "schema_path", "dewey", "kind", "value", "scalars"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[key, "schema_path", "dewey", "kind", "value", "scalars"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, json_col).mapInPandas(nodes, f"`{key}` {kind}, {NODE_SCHEMA}")


def ordinal(dewey: Column, depth: int) -> Column:
    """Ordinal at ``depth`` (the root is depth 0) of a label, null above it."""
    return F.get(F.split(dewey, r"\."), F.lit(depth)).cast("int")


def ancestor(dewey: Column, depth: int) -> Column:
    """Label of the ancestor at ``depth``: the label cut after it."""
    return F.substring_index(dewey, ".", depth + 1)


ENTRY, CONTENT = "$.log.entries[]", "$.log.entries[].response.content"
LISTED, MAPPED = "$.log.entries[].response.headers[]", "$.log.entries[].response.headers{}"


class HarTables:
    """Captures, entries, contents and headers of HAR files as related tables.

    Keys: a capture is (key); an entry (key, entry_no); a content (key, entry_no); a header (key, entry_no, header_no), all
    counted from 1 in file order; null entries and headers keep their places.  Each row also has its Dewey label ``dewey`` and
    its parent's, ``parent``.  Duplicate captures stay apart under their keys.
    """

    def __init__(self, df: DataFrame, key: str = "capture_id", json_col: str = "har"):
        self.df, self.key, self.json_col = df, key, json_col

    def _nodes(self, *paths: str) -> DataFrame:
        return dewey_nodes(self.df, self.key, self.json_col, [p.replace("headers{}", "headers.{}") for p in paths])

    def captures(self) -> DataFrame:
        """(key, dewey, top_kind): every readable file."""
        return self._nodes("$").select(self.key, "dewey", F.col("kind").alias("top_kind"))

    @staticmethod
    def _entries(nodes: DataFrame, key: str) -> DataFrame:
        return nodes.filter(F.col("schema_path") == ENTRY).select(
            key, ordinal(F.col("dewey"), 3).alias("entry_no"), "dewey", ancestor(F.col("dewey"), 0).alias("parent"), F.col("kind").alias("entry_kind"),
            F.col("scalars")["startedDateTime"].alias("started"))

    def entries(self) -> DataFrame:
        return self._entries(self._nodes(ENTRY), self.key)

    def contents(self) -> DataFrame:
        at = F.col("dewey")
        return self._nodes(CONTENT).filter(F.col("kind") == "object").select(
            self.key, ordinal(at, 3).alias("entry_no"), "dewey", ancestor(at, 3).alias("parent"), F.col("scalars")["text"].alias("text"),
            F.col("scalars")["encoding"].alias("encoding"), F.col("scalars")["mimeType"].alias("mimetype"), F.col("scalars")["size"].cast("bigint").alias("size"))

    def headers(self) -> DataFrame:
        return self._headers(self._nodes(LISTED, MAPPED), self.key)

    @staticmethod
    def _headers(nodes: DataFrame, key: str) -> DataFrame:
        at = F.col("dewey")
        return nodes.filter(F.col("schema_path").contains(".headers")).select(
            key, ordinal(at, 3).alias("entry_no"), ordinal(at, 6).alias("header_no"), "dewey", ancestor(at, 3).alias("parent"),
            F.col("scalars")["name"].alias("name"), F.col("scalars")["value"].alias("value"))

    def header_rows(self) -> DataFrame:
        """(key, entry_no, header_no): a row per header with a non-empty name; header_no 0 for an entry without one, entry_no 0
        for a readable file without entries.

        One pass over the files and no exchange: a file's nodes come from one task in document order, and a node's parent is its
        label cut, so each row is told as soon as the next label doesn't lie under it.
        """
        key, json_col, names = self.key, self.json_col, (LISTED, MAPPED.replace("headers{}", "headers.{}"))
        root = _wanted(["$", ENTRY, *names])

        def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list[tuple] = []
                for k, text in zip(batch[key], batch[json_col]):
                    valid, value = parse_json(text)
                    if valid:
                        out.extend((k, *x) for x in _header_rows(_walk(value, root, "$", "1")))
                    if len(out) >= 50_000:
                        yield pd.DataFrame(out, columns=[key, "entry_no", "header_no"])
                        out = []
                yield pd.DataFrame(out, columns=[key, "entry_no", "header_no"])

        kind = self.df.schema[key].dataType.simpleString()
        return self.df.select(key, json_col).mapInPandas(rows, f"`{key}` {kind}, entry_no int, header_no int")


def _header_rows(nodes: Iterable[tuple]) -> Iterator[tuple[int, int]]:
    """(entry_no, header_no) of a file's nodes in document order; 0 for a level that has nothing named under it."""
    entry, told = 0, False
    for path, label, _, _, scalars in nodes:
        steps = label.split(".")
        if path == ENTRY:
            if entry and not told:
                yield entry, 0
            entry, told = int(steps[3]), False
        elif len(steps) > 6 and scalars and scalars.get("name"):
            told = True
            yield entry, int(steps[6])
    if not told:
        yield entry, 0
