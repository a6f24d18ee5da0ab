"""Oversized texts into ordered pieces under a limit (problem 5).

Sizes are prefix sums over the units of a text (characters here), boundaries are sorted arrays of positions, one for each
strength: blank line, line, sentence, word gap.  A piece's end is the last boundary at or under its limit, found by binary
search; the next piece starts ``overlap`` units before that end.  Where no boundary helps, the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.body import decode_body

LIMIT, OVERLAP = 50_000, 50
#: Ends of blank lines; of lines and block elements; of sentences; of words, also where a JSON item or a tag ends.
BOUNDARIES = tuple(
    map(
        re.compile,
        (
            r"\n[ \t\r]*\n\s*",
            r"\n+|</(?:p|div|li|h\d|tr|td|section|article)>",
            r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+[」』”]*|\}\s*,\s*",
            r"\s+|>(?=<)|,(?=[\"{\[])",
        ),
    )
)


def boundary_arrays(text: str) -> list[np.ndarray]:
    """Sorted positions at which a cut is natural, strongest kind first."""
    return [np.fromiter((m.end() for m in b.finditer(text)), np.int64) for b in BOUNDARIES]


def split_spans(prefix: np.ndarray, levels: list[np.ndarray], limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans (start, end) over units 0..n whose sizes have the prefix sums ``prefix`` (n + 1 values from 0).

    Each span's size is at most ``limit``; each after the first starts so that it repeats the last ``overlap`` of size of the
    one before (as many whole units as fit in it).  A stronger boundary is taken only if the span is at least ``least`` of the
    limit, then any boundary that makes progress, then a hard cut.  A unit larger than the limit is a span of its own.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")
    n = len(prefix) - 1
    if n <= 0:
        return []
    spans, start, done = [], 0, 0
    while True:
        end = int(np.searchsorted(prefix, prefix[start] + limit, "right")) - 1
        if end >= n:
            spans.append((start, n))
            return spans
        hard = max(end, done + 1)
        end = hard
        enough = int(np.searchsorted(prefix, prefix[start] + limit * least, "left"))
        for floor in (max(enough, done + 1), done + 1):
            for cuts in levels:
                k = int(np.searchsorted(cuts, hard, "right")) - 1
                if k >= 0 and cuts[k] >= floor:
                    end = int(cuts[k])
                    break
            else:
                continue
            break
        spans.append((start, end))
        done = end
        start = max(int(np.searchsorted(prefix, prefix[end] - overlap, "left")), start + 1)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of a text in characters.  Texts of at most ``limit`` are one span, empty ones none."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    levels = boundary_arrays(text)
    spans = split_spans(np.arange(len(text) + 1), levels, limit, overlap)
    return spans


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, encoding: str | None = None, mimetype: str | None = None) -> DataFrame:
    """Pieces of the texts longer than ``limit``: (key, piece_no from 1, start_pos, end_pos, n_pieces, piece).

    Shorter, empty and null texts give no row: they need no cut.  Repeated keys are cut row by row.  With ``encoding`` and
    ``mimetype`` the text is a response's and its body is cut; a body never has more characters than its text, so rows with
    texts up to the limit are left out before anything is decoded.  Other columns of ``df`` aren't read.
    """
    names = [key, text, *([encoding, mimetype] if encoding else [])]

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                body = decode_body(*row[1:]) if encoding else row[1]
                if len(body) <= limit:
                    continue
                spans = split_text(body, limit, overlap)
                yield pd.DataFrame(
                    [(row[0], no, s, e, len(spans), body[s:e]) for no, (s, e) in enumerate(spans, 1)],
                    columns=[key, "piece_no", "start_pos", "end_pos", "n_pieces", "piece"],
                )

    kind = df.schema[key].dataType.simpleString()
    long: Column = F.char_length(F.col(text)) > limit
    return df.select(*names).filter(long).mapInPandas(cut, f"`{key}` {kind}, piece_no int, start_pos int, end_pos int, n_pieces int, piece string")
