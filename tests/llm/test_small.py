"""Splitting, encoding, packing, look-alikes."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import encoding, lookalikes, packing, splitting

pieces = st.lists(st.sampled_from(["a", "bc ", "d. ", "e\n", "\n\n", "漢", "。", "x" * 30, '},{"', "</p>"]), max_size=120).map("".join)


@settings(max_examples=200, deadline=None)
@given(pieces, st.integers(2, 40), st.data())
def test_split_covers(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = splitting.split_text(text, limit, overlap)
    if len(text) <= limit:
        assert spans == ([(0, len(text))] if text else [])
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert 0 < b - a <= limit and a < c and b < d
        assert c == b - overlap or c == a + 1  # one more than the start only where overlap would stand still
    assert text[: spans[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(spans, spans[1:])) == text


def test_split_at_boundaries():
    text = "One sentence here. " * 10 + "\n\n" + "word " * 40 + "z" * 300
    spans = splitting.split_text(text, 100, 10)
    cuts = {int(x) for level in splitting.boundary_arrays(text) for x in level}
    for a, b in spans[:-1]:
        if any(a + 10 < x <= a + 100 for x in cuts):
            assert b in cuts
    with pytest.raises(ValueError):
        splitting.split_spans(np.arange(5), [], 3, 3)
    assert splitting.split_spans(np.array([0, 9, 10, 11]), [], 5, 1) == [(0, 1), (1, 3)]  # a unit over the limit stands alone


def test_split_operator(spark):
    rows = [(1, "w " * 40, "x"), (2, None, "y"), (3, "", "z"), (4, "short", "s"), (1, "v " * 40, "again")]
    df = spark.createDataFrame(rows, "entry_id bigint, text string, piece string")
    out = splitting.split_items(df, "entry_id", "text", 50, 5).collect()
    assert {r.entry_id for r in out} == {1} and len(out) == 4 and all(len(r.piece) <= 50 for r in out)
    assert splitting.split_items(df.limit(0), "entry_id", "text", 50, 5).count() == 0


@pytest.fixture(scope="module")
def replay():
    return encoding.MergeReplay(f"{encoding.TOKENIZERS}/{encoding.MODEL}")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/{encoding.MODEL}")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("ab '\n\t", max_size=60) | st.sampled_from(["<|endoftext|>", "aaaaaaaaaaaaaaaaa", "  \n  x", "é́ 漢字 😀", "don't we'll I'M"]), max_size=6))
def test_ids_like_the_library(replay, texts):
    assert replay.encode(texts) == library(texts)


def test_ids_with_little_memory(replay, monkeypatch):
    texts = ["the cat sat", "on the mat", "the cat", "zzz qq"] * 3
    monkeypatch.setattr(encoding, "KEPT", 3)
    assert [encoding.MergeReplay(f"{encoding.TOKENIZERS}/{encoding.MODEL}").encode([t])[0] for t in texts] == library(texts)


def test_encode_operator(spark):
    df = spark.createDataFrame([(1, "hello", 0), (2, None, 0), (3, "", 0), (1, "hello", 0)], "doc_id bigint, text string, ids int")
    out = sorted((r.doc_id, r.ids) for r in encoding.encode_corpus(df, "doc_id", "text").collect())
    ids = library(["hello"])[0]
    assert out == [(1, ids), (1, ids), (2, []), (3, [])]
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.n_ids for r in encoding.encode_corpus(df, "doc_id", "text", lengths_only=True).collect()) == [0, 0, len(ids), len(ids)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_best_fill(counts, room):
    sums = {0}
    for s, n in counts.items():
        sums = {x + s * k for x in sums for k in range(n + 1)}
    got = packing.best_fill(dict(counts), room)
    assert all(got[s] <= counts[s] for s in got) and sum(s * n for s, n in got.items()) == max(x for x in sums if x <= room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=8))
def test_pack_histogram(histogram):
    steps = packing.pack_histogram(histogram, 20)
    for s, n in histogram.items():
        assert sum(p.get(s, 0) * k for p, k in steps) == n
    assert all(sum(s * n for s, n in p.items()) <= 20 for p, _ in steps)


def test_pack_operator(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_TASK", 40)  # a hot size in several tasks
    r = random.Random(3)
    rows = [(i, 7 if i % 3 == 0 else r.choice([None, 0, 1, 2, 10, 25, 64])) for i in range(400)] + [(5, 3), (5, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, size int")
    out = [r.asDict() for r in packing.pack(df, "doc_id", "size", 20).collect()]
    fill = {}
    for x in out:
        fill[x["container"]] = fill.get(x["container"], 0) + x["n"]
    total = sum(s or 0 for _, s in rows)
    assert max(fill.values()) <= 20 and sum(fill.values()) == total and len(fill) <= total / 20 * 1.05 + 1
    by = {}
    for x in out:
        by.setdefault(x["doc_id"], []).append(x)
    for k, s in rows[:400]:
        if k == 5:
            continue
        parts = sorted(by[k], key=lambda x: x["piece_no"])
        assert sum(p["n"] for p in parts) == (s or 0) and [p["offset"] for p in parts] == [20 * i for i in range(len(parts))]
        assert len(parts) == max(1, -(-(s or 0) // 20))
    assert len(by[5]) == 3
    assert packing.pack(df.limit(0), "doc_id", "size", 20).count() == 0


SAME = [("café", "café"), ("Ｔｏｔａｌ　１２", "Total 12"), ("a​b\xadc", "abc"), ("tot al", "tot al"), ("Τotal", "Total"), ("раypаl", "paypal"), ("ﬁne", "fine"), ("ﾊﾟ", "パ"), ("a\r\nb", "a\nb"), ("‑", "-"), ("﻿x", "x"), ("Å", "Å"), ("각", "각")]
DIFFERENT = [("cafe", "café"), ("x2", "x²"), ("A", "a"), ("1l", "11"), ("½", "1/2"), ("👨‍👩‍👧", "👨👩👧"), ("a b", "ab"), ("क्‍ष", "क्ष"), ("ß", "ss"), ("a  b", "a b"), ("œ", "oe"), ("O", "0"), ("—", "-")]


@pytest.mark.parametrize("a, b", SAME)
def test_reads_the_same(a, b):
    assert lookalikes.skeleton(a) == lookalikes.skeleton(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_reads_differently(a, b):
    assert lookalikes.skeleton(a) != lookalikes.skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_final(text):
    form = lookalikes.skeleton(text)
    assert lookalikes.skeleton(form) == form
    assert lookalikes.skeleton(unicodedata.normalize("NFC", text)) == form


def test_pairs_like_brute_force(spark):
    r = random.Random(2)
    base = ["total 12", "café", "x", "", None, "paypal", "unique"]
    rows = []
    for i in range(120):
        t = r.choice(base)
        if t and r.random() < 0.4:
            t = r.choice([t.replace("a", "а"), t + "​", unicodedata.normalize("NFD", t), t.replace(" ", "\xa0")])
        rows.append((i, t, "x"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, s string")
    want = {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x and y and x != y and lookalikes.skeleton(x) == lookalikes.skeleton(y)}
    got = [tuple(x) for x in lookalikes.lookalike_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert lookalikes.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    forms = {x.doc_id: x.form for x in lookalikes.normalise(df, "doc_id", "text", "form").collect()}
    assert all(forms[i] == lookalikes.skeleton(t) for i, t, _ in rows)


def test_every_look_alike_has_its_prototype():
    table = lookalikes.look_alikes()
    assert len(table) > 150
    for ch, prototype in table.items():
        assert len(ch) == len(prototype) == 1 and lookalikes.skeleton(ch) == unicodedata.normalize("NFD", prototype), (ch, prototype)
    for pair in ("ӀI", "ՕO", "ϜF", "ⲞO", "ⲟo", "ꓮA", "ꮯc", "ıi", "−-", "‚,", "ꞌ'"):
        assert lookalikes.skeleton(pair[0]) == pair[1], pair


def test_classes_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "PER_TASK", 7)  # hot texts in parts
    base = ["total 12", "t\u043etal 12", "total\xa012", "other", "", None, "x"]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 7]) for i in range(210)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = {}
    for i, t in rows:
        if t:
            groups.setdefault(lookalikes.skeleton(t), {}).setdefault(t, []).append(i)
    want = {}
    for texts in groups.values():
        if len(texts) > 1:
            ids = [i for x in texts.values() for i in x]
            want |= {i: (min(ids), len(texts), len(ids) - len(x)) for x in texts.values() for i in x}
    got = {r.doc_id: (r.class_id, r.n_texts, r.n_links) for r in lookalikes.lookalike_classes(df, "doc_id", "text").collect()}
    assert got == want and want
    pairs = {tuple(r) for r in lookalikes.lookalike_pairs(df, "doc_id", "text").collect()}
    assert len(pairs) == sum(n for _, _, n in want.values()) // 2
    assert lookalikes.lookalike_classes(df.limit(0), "doc_id", "text").count() == 0


def test_elder_words_are_kept(monkeypatch):
    texts = [f"word{i} the cat" for i in range(40)]
    monkeypatch.setattr(encoding, "KEPT", 10)
    tool = encoding.MergeReplay(f"{encoding.TOKENIZERS}/{encoding.MODEL}")
    assert [tool.encode([t])[0] for t in texts] == library(texts)
    assert " the" in tool.known or " the" in tool.elder
