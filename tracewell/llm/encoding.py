"""Whole corpora into token ids of a public byte-level tokenizer, by merge replay (problem 6).

A text's ids are those of its words (pieces of the split pattern) one after the other, and a word's ids don't depend on where it
stands.  So the merges are replayed over distinct words only.  All new words of a block of texts lie in one array of symbols; an
inverted index leads from a pair of neighbouring symbols to the positions that have it; a heap gives the pairs in rank order, and
each merge touches only the positions of its pair and their neighbours.

Blocks are parts of a partition: words aren't gathered over the cluster, as a shuffle of all words of all texts would move more
than the texts themselves.  A worker keeps the ids of words it has seen, up to a bound; the result doesn't depend on that.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

TOKENIZERS, MODEL = "/opt/tokenizers", "byte_bpe_50k.json"
#: The split pattern of this vocabulary: a fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker, and characters of the longest word kept.
KEPT, KEPT_LENGTH = 200_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeReplay:
    """The vocabulary's merges, and the ids of words by replaying them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.of_byte = [ids[x] for x in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.split = regex.compile(SPLIT)
        # words seen lately, and before: the elder go when the younger are many, so frequent words stay
        self.known: dict[str, tuple[int, ...]] = {}
        self.elder: dict[str, tuple[int, ...]] = {}

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, all words at once."""
        sym: list[int] = []
        ends: list[int] = []
        for w in words:
            sym.extend(map(self.of_byte.__getitem__, w.encode("utf-8", "replace")))
            sym.append(-1)  # between words; in no merge
            ends.append(len(sym))
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        merges = self.merges
        for i in range(n - 1):
            pair = (sym[i], sym[i + 1])
            if pair in merges:
                index.setdefault(pair, []).append(i)
        heap = [(merges[p][0], p) for p in index]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            new = merges[pair][1]
            places.sort()
            for i in places:
                j = after[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # a neighbour was merged meanwhile
                sym[i], sym[j] = new, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (right := (new, sym[k])) in merges:
                        if right not in index:
                            index[right] = []
                            heapq.heappush(heap, (merges[right][0], right))
                        index[right].append(i)
                h = before[i]
                if h >= 0 and (left := (sym[h], new)) in merges:
                    if left not in index:
                        index[left] = []
                        heapq.heappush(heap, (merges[left][0], left))
                    index[left].append(h)
        out, start = [], 0
        for end in ends:
            out.append(tuple(x for x in sym[start : end - 1] if x >= 0))
            start = end
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; the empty list for empty and for null."""
        split, known = self.split.findall, self.known
        cut = [split(t) if t else [] for t in texts]
        fresh = []
        for w in {w for words in cut for w in words if w not in known}:
            if w in self.elder:
                known[w] = self.elder[w]
            else:
                fresh.append(w)
        own = dict(zip(fresh, self.replay(fresh))) if fresh else {}
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids.extend(own[w] if w in own else known[w])
            out.append(ids)
        known.update((w, x) for w, x in own.items() if len(w) <= KEPT_LENGTH)
        if len(known) > KEPT:
            self.known, self.elder = {}, known if len(known) <= 4 * KEPT else {}
        return out


@lru_cache(maxsize=2)
def replayer(path: str) -> MergeReplay:
    return MergeReplay(path)


def blocks(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Parts of a batch of about ``most`` characters, a text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, key: str, text: str, model: str = MODEL, folder: str = TOKENIZERS, lengths_only: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row, or (key, n_ids int).

    Null and empty texts give the empty list.  Strings of special tokens in a text are ordinary text.  Repeated rows and keys
    are encoded row by row; other columns of ``df`` aren't read.  ``folder`` must be readable by every executor.
    """
    path = os.path.join(folder, model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = replayer(path)
        for batch in batches:
            texts = batch[text].tolist()
            for a, b in blocks(texts):
                ids = tool.encode(texts[a:b])
                col = [len(x) for x in ids] if lengths_only else [np.asarray(x, np.int32) for x in ids]
                yield pd.DataFrame({key: batch[key].iloc[a:b].to_numpy(), ("n_ids" if lengths_only else "ids"): col})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, " + ("n_ids int" if lengths_only else "ids array<int>"))
