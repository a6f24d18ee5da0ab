"""Template residue, filler, error messages and demands for scripts instead of content (problem 4).

A body is taken apart into the sentences that a reader sees: of text nodes of HTML, of string values of JSON (HTML inside them too),
of lines of plain text; never of code.  A sentence's message template is its token list with numbers, codes and links as wildcards.

Templates are mined over all bodies.  They lie in a prefix tree of fixed depth, by length and first tokens.  Under a leaf a token
becomes a wildcard where many templates differ in that place alone; that is a count of all templates with the place masked, so it
doesn't depend on any order.  Each mined template is judged once, from its words and from what was counted of it (in how many bodies
it stands, in how many of them alone), and the verdict goes back to the records by the template's id: message, content, or neither
(titles, buttons).  A body is residue if a sentence of it is a message and none is content.

The judge is a logistic regression on words, stems and pairs of words, learnt from the messages and sentences of ``residue_text``.

Unresolved slots are looked for separately, in all segments, as one is enough amid real content.  A sentence that talks about a
slot is none.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.body import decode_body
from tracewell.functions.text import strip
from tracewell.io import once
from tracewell.llm.garbled import is_media
from tracewell.llm.residue_text import examples

#: First tokens that make a leaf with the length; values of one place from which on it is a wildcard.
DEPTH, VALUES = 2, 4
#: Probability of a message from which on a template is one, and up to which it is content; what a template is worth that stands
#: alone in its bodies, in log odds.
MESSAGE, ORDINARY, ALONE = 0.5, 0.25, 1.0
#: Messages are rarer in pages than among the examples: taken from the log odds.
RARER = 1.5
#: Passes over the examples, rate, penalty, seed.
EPOCHS, RATE, PENALTY, SEED = 25, 0.4, 2e-3, 3
#: Templates of a task that are counted before they are handed on.
KEPT = 100_000

_HIDDEN = re.compile(r"<(script|style|template|noscript|title|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.I | re.S)
_TAG = re.compile(r"<(?<!<<)(?:/?[a-zA-Z][\w:-]*(?:\s[^<>]*)?/?|![^<>]*)>")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|font|small|sup|sub|mark|abbr|code|wbr)\b[^<>]*>", re.I)
_STRING = re.compile(r'"((?:[^"\\]|\\.)*+)"(\s*:)?')
_JSON = re.compile(r"\s*(?:[a-zA-Z_$][\w.$]*\s*\(\s*)?[{\[]")
_HTML = re.compile(r"<(?:!doctype|html|head|body|div|p|span|h\d|ul|li|table|td|main|section|header|a|center|br)\b", re.I)
_SCRIPT_TYPE = re.compile(r"javascript|ecmascript", re.I)

# Slots: each way of writing one, around a name.
_NAME = r"[A-Za-z][A-Za-z]*(?:[_.\-][A-Za-z]+)*"
#: Names that a bare word in single brackets must have to be a slot.
SLOT_WORDS = "amount|city|code|customer|date|email|first|firstname|first_name|last|lastname|last_name|link|name|number|order|phone|price|product|status|store|title|total|url|user|username|voucher|vouchercode"
_SLOT = re.compile(
    r"\{\{\{?\s*[#/>&]?\s*" + _NAME + r"[^{}\n]*+\}\}\}?|\{%-?\s*" + _NAME + r"[^%\n]*+-?%\}|[$#]\{\s*" + _NAME + r"[^{}\n]*+\}|<%[=-]?\s*" + _NAME + r"[^%\n]*+%>"
    r"|\[\[\s*" + _NAME + r"\s*\]\]|%%\s*" + _NAME + r"\s*%%|@@\s*" + _NAME + r"\s*@@|\*\|\s*" + _NAME + r"\s*\|\*|<<\s*" + _NAME + r"\s*>>|\[(?:INSERT|ENTER|YOUR|ADD)[ _][^\[\]\n]++\]"
    r"|(?<![\w])__" + _NAME + r"__(?![\w])|(?<![\w%])%(?:" + SLOT_WORDS.upper() + r")%|(?<![\w{$#])\{(?:" + _NAME + r")\}(?!\})|\[(?:(?:" + SLOT_WORDS.upper() + r")(?:[ _.](?:" + SLOT_WORDS.upper() + r"))?)\]"
    r"|<(?:" + SLOT_WORDS + r"|voucherCode|FIRSTNAME|LASTNAME|NAME|[a-z]+[_.][a-z]+)>"
)
#: Each alternative begins with a fixed sign, so that others are passed over quickly; likewise in ``_TAG``.
_MAY_HAVE_SLOT = re.compile(r"&#(?:60|123|37|91|64|36|35|42|x3c|x7b);|\{\{|\{%|\$\{|#\{|<%|&lt;|\\u003c|\[\[|%%|@@|\*\||<<|\[(?:INSERT|ENTER|YOUR|ADD|[A-Z]{4})|__[A-Za-z]|%[A-Z]{3}|\{[A-Za-z]|<(?:[a-z]+[_.][a-z]+|" + SLOT_WORDS + "|voucherCode|FIRSTNAME|LASTNAME|NAME)>")
#: A sign that each way of writing a slot has.
_SLOT_SIGN = re.compile(r"[{<\[%@*_]")
#: A sentence that speaks of slots.
_ABOUT = re.compile(r"\b(?:such as|for example|e\.g\.|mail merge|placeholder|is swapped|is replaced|are replaced|syntax|template (?:language|engine)|a field|the field|field (?:named|called)|means that)\b", re.I)

_WILD = re.compile(r"https?://\S+|www\.\S+|[#№]?(?:[A-Za-z]{1,3}[/-]?)?\d[A-Za-z0-9_.,:/-]*")
_END = re.compile(r"[.!?…。！？]\W*$")
_CJK = re.compile("[぀-ヿ一-鿿]")

_SENTENCE_END = re.compile(r"[.!?…。！？](?:(?<=[。！？])|[\"'»”’)\]]*\s+)")
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\*|\d+")


class _Known(dict):
    """What ``of`` gives for a short token, kept for the next time."""

    #: Tokens that are kept, and how long they are at most.
    MOST, LONG = 1 << 16, 32

    def __init__(self, of: Callable[[str], object]):
        self.of = of

    def __missing__(self, token: str) -> object:
        out = self.of(token)
        if len(token) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[token] = out
        return out


_masked_token = _Known(lambda token: _WILD.sub("*", token)).__getitem__


def mask(sentence: str) -> str:
    """A sentence's template: small letters, single spaces, numbers, codes and links as wildcards, none of which has a space."""
    return " ".join(map(_masked_token, sentence.lower().split()))


def template_id(template: str) -> int:
    """64 bits that stand for a template."""
    return xxhash.xxh64_intdigest(template.encode("utf-8", "replace")) - (1 << 63)


# --- the judge ---------------------------------------------------------------------------------------------------------------


def features(template: str) -> list[str]:
    words = _WORDS.findall(template.lower().replace("’", "'"))
    out = {"bias", f"n={min(len(words), 12)}"}
    for w in words:
        out.add(w)
        if len(w) > 5:
            out.add(w[:5] + "~")
        if len(w) > 8:
            out.add(w[:8] + "~")
        if _CJK.search(w):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
            out.update(w[i : i + 3] for i in range(len(w) - 2))
    out.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    if words:
        out.add(f"^{words[0]}")
    return sorted(out)


@lru_cache(maxsize=1)
def judge_weights() -> dict[str, float]:
    """Weights of the judge, learnt once in a process, in about two seconds."""
    data = [(features(mask(x)), y) for x, y in examples(SEED)]
    count: dict[str, int] = defaultdict(int)
    for fs, _ in data:
        for f in fs:
            count[f] += 1
    names = {f: i for i, f in enumerate(f for f, n in count.items() if n > 1)}
    w, s = np.zeros(len(names)), np.full(len(names), 1e-8)
    rows = [(np.array([names[f] for f in fs if f in names]), float(y)) for fs, y in data]
    r = np.random.default_rng(SEED)
    for turn in range(EPOCHS):
        for i in r.permutation(len(rows)):
            ids, y = rows[i]
            g = 1 / (1 + math.exp(-w[ids].sum())) - y
            step = g + PENALTY * w[ids]
            s[ids] += step * step
            w[ids] -= RATE * step / np.sqrt(s[ids])
    return {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}


def odds(template: str, weights: dict[str, float]) -> float:
    """Log odds that a template's words are a message."""
    return sum(weights.get(f, 0.0) for f in features(template))


def verdict(template: str, alone: float, weights: dict[str, float]) -> int:
    """BAD, CONTENT or CHROME (neither).  ``alone`` is the share of its bodies, from 0 to 1, in which nothing but a few words stand beside it."""
    if not any(c.isalpha() for c in template):
        return CHROME
    words = [w for w in re.split(r"[^a-z]+", template) if w]
    if len(words) >= 3 and sum(w in LATIN for w in words) >= 0.7 * len(words):
        return BAD
    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds(template, weights) - RARER + ALONE * (alone - 0.5)))))
    if p >= MESSAGE:
        return BAD
    if template.startswith(("(c) ", "© ", "copyright ")):
        return CHROME
    ended = _END.search(template) is not None
    if _CJK.search(template):
        return CONTENT if p <= ORDINARY and (ended or len(template) > 12) else CHROME
    return CONTENT if p <= ORDINARY and (ended or template.count(" ") > 2) else CHROME


#: Words of Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
CONTENT, CHROME, BAD = 0, 1, 2


# --- what a reader sees ------------------------------------------------------------------------------------------------------


def _unquote(inner: str) -> str:
    try:
        return json.loads(f'"{inner}"', strict=False) if "\\" in inner else inner
    except ValueError:
        return inner


def _html_segments(text: str) -> Iterator[str]:
    bare = _INLINE.sub("", _HIDDEN.sub("<br>", text))
    for part in _TAG.split(bare):
        if part and not part.isspace():
            for line in (html.unescape(part) if "&" in part else part).splitlines():
                if line and not line.isspace():
                    yield line.strip()


_CODE = re.compile(r"\s*(?://|/\*|(?:var|let|const|function|export|import)\s+[\w${*]|if\s*\(|(?:window|document|self|module|exports)[.\[]|setTimeout\(|[(!]\s*function\b|[\"']use strict)")
_CALL_END = re.compile(r"[)\]}]\s*;?\s*\Z")


def segments(body: str, mimetype: str | None) -> Iterator[str]:
    """What a reader sees of a body, part by part."""
    kind = (mimetype or "").lower()
    code = _SCRIPT_TYPE.search(kind) is not None
    if _JSON.match(body) and (not code or _CALL_END.search(body)):
        for m in _STRING.finditer(body):
            if m[2]:
                continue
            value = _unquote(m[1])
            if "<" in value and _HTML.search(value):
                yield from _html_segments(value)
            else:
                for line in value.splitlines():
                    if line and not line.isspace():
                        yield line.strip()
    elif code or _CODE.match(body):
        return
    elif "html" in kind or body.lstrip()[:1] == "<" or _HTML.search(body):
        yield from _html_segments(body)
    else:
        for m in re.finditer(r"[^\r\n]+", body):
            if not m[0].isspace():
                yield m[0].strip()


def has_slot(body: str, mimetype: str | None, shown: list[str] | None = None) -> bool:
    """Whether what a reader sees has an unfilled slot that the sentence doesn't just talk about."""
    if not _MAY_HAVE_SLOT.search(body):
        return False
    titles = (html.unescape(m[1]) for m in _TITLE.finditer(body)) if "<title" in body else ()
    for s in (*(segments(body, mimetype) if shown is None else shown), *titles):
        if not _SLOT_SIGN.search(s):
            continue
        for m in _SLOT.finditer(s):
            start = max((s.rfind(c, 0, m.start()) for c in ".!?"), default=-1) + 1
            end = min((k for c in ".!?" if (k := s.find(c, m.end())) >= 0), default=len(s))
            if not _ABOUT.search(s[start:end]):
                return True
    return False


def _split(segment: str) -> Iterator[str]:
    """The sentences of a segment, without what closes and parts them."""
    start = 0
    for m in _SENTENCE_END.finditer(segment):
        yield segment[start : m.start() + 1]
        start = m.end()
    yield segment[start:]


def sentences(body: str, mimetype: str | None, shown: list[str] | None = None) -> list[str]:
    """What a reader sees of a body, sentence by sentence."""
    return [x for s in (segments(body, mimetype) if shown is None else shown) for x in _split(s) if x and not x.isspace()]


def hidden_sentences(body: str) -> list[str]:
    """What ``noscript`` shows, which counts where a page has no content."""
    if "<noscript" not in body.lower():
        return []
    return [x for m in _NOSCRIPT.finditer(body) for s in _html_segments(m[1]) for x in _split(s) if x and not x.isspace()]


def templates_of(texts: Iterable[str]) -> list[str]:
    """The templates of sentences, each once, in order; those without a letter say nothing."""
    return [x for x in dict.fromkeys(map(mask, texts)) if _LETTER.search(x)]


# --- mining ------------------------------------------------------------------------------------------------------------------


def _taken_apart(df: DataFrame, key: str, text: str, encoding: str, mimetype: str) -> DataFrame:
    """Rows of two kinds: of records (key, slot, ids, hidden), and of templates (id, template, in how many bodies, alone in how many).

    Templates are counted in the task before they are handed on, those of bodies with a slot too, whose records need no ids.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list] = {}

        def counted() -> pd.DataFrame:
            rows = [(x, *c) for x, c in counts.items()]
            counts.clear()
            out = pd.DataFrame(rows, columns=["template", "id", "n", "alone"])
            return out.assign(**{key: None, "slot": None, "ids": None, "hidden": None})[columns]

        for batch in batches:
            rows = []
            for k, t, e, m in batch.itertuples(index=False, name=None):
                body = decode_body(t, e, m)
                if not body:
                    continue
                shown = list(segments(body, m))  # taken apart once
                slot = has_slot(body, m, shown)
                seen, behind = templates_of(sentences(body, m, shown)), templates_of(hidden_sentences(body))
                if not seen and not behind and not slot:
                    continue
                ids = []
                for many, into in ((seen, ids), (behind, hidden := [])):
                    for x in many:
                        if (c := counts.get(x)) is None:
                            c = counts[x] = [template_id(x), 0, 0]
                        into.append(c[0])
                        c[1] += 1
                        c[2] += len(many) <= FEW
                rows.append((k, True, [], []) if slot else (k, False, ids, hidden))
            yield pd.DataFrame(rows, columns=[key, "slot", "ids", "hidden"]).assign(id=None, template=None, n=None, alone=None)[columns]
            if len(counts) > KEPT:
                yield counted()
        yield counted()

    kind = df.schema[key].dataType.simpleString()
    columns = [key, "slot", "ids", "hidden", "id", "template", "n", "alone"]
    rows = df.select(key, text, encoding, mimetype).filter((F.col(text) != "") & ~is_media(F.col(mimetype)))
    return rows.mapInPandas(run, f"`{key}` {kind}, slot boolean, ids array<bigint>, hidden array<bigint>, id bigint, template string, n bigint, alone bigint")


#: Sentences of a body up to which each counts as alone.
FEW = 3


def counted(templates: DataFrame) -> DataFrame:
    """(id, template, n, alone) of templates that may repeat: each once."""
    return templates.groupBy("id", "template").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"))


_token_hash = _Known(lambda token: xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))).__getitem__


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def masked_forms(texts: Iterable[str], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, form): for each place of a template from ``depth`` on that isn't a wildcard, the hash of the template without it.

    A template's hash is the exclusive or of its tokens' hashes, each mixed with its place, so a place is taken out in one step.
    """
    tokens = [t.split(" ") for t in texts]
    sizes = np.array([len(t) for t in tokens])
    hashes = np.fromiter((_token_hash(w) for t in tokens for w in t), np.uint64, sizes.sum())
    starts = sizes.cumsum() - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(hashes)) - starts[row]
    places = _mixed(hashes + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    form = np.bitwise_xor.reduceat(places, starts)[row] ^ places
    open_ = (at >= depth) & (hashes != np.uint64(_token_hash("*")))
    return row[open_], at[open_], form[open_]


def wild_places(templates: DataFrame, depth: int, values: int) -> DataFrame:
    """(id, wild) of the distinct templates that get wildcards, with their places.

    Hashes of masked templates meet in one exchange.  What a batch has ``values`` times is settled there: it sends one row that
    speaks for all of them, so a masked form that very many templates share brings a few rows of a batch to its task.
    """

    def masked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            row, at, form = masked_forms(batch["template"], depth)
            ids = batch["id"].to_numpy()[row]
            forms, which, many = np.unique(form, return_inverse=True, return_counts=True)
            settled = many[which] >= values
            key = np.where(settled, _mixed(form ^ ids.view(np.uint64)), form)  # a settled row meets no other
            told = forms[many >= values]
            yield pd.DataFrame({
                "form": np.concatenate([key, told]).view(np.int64), "id": np.concatenate([ids, np.zeros(len(told), np.int64)]),
                "at": np.concatenate([at, np.full(len(told), -1)]), "n": np.concatenate([np.where(settled, values, 1), np.full(len(told), values)]),
            })

    def common(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (parts := [b for b in batches if len(b)]):
            return
        rows = pd.concat(parts, ignore_index=True)
        _, which = np.unique(rows["form"].to_numpy(), return_inverse=True)
        enough = np.bincount(which, weights=rows["n"])[which] >= values
        yield rows.loc[enough & (rows["at"] >= 0), ["id", "at"]]

    forms = templates.select("id", "template").mapInPandas(masked, "form bigint, id bigint, at int, n int")
    return forms.repartition("form").mapInPandas(common, "id bigint, at int").groupBy("id").agg(F.collect_set("at").alias("wild"))


def mined(templates: DataFrame, depth: int = DEPTH, values: int = VALUES) -> DataFrame:
    """(id, template, mined, n, alone) of distinct templates: ``mined`` has more wildcards.

    A place behind the leaf's first ``depth`` tokens becomes a wildcard where at least ``values`` templates are equal but for it.
    """
    out = templates.join(wild_places(templates, depth, values), "id", "left")
    more = F.array_join(F.transform(F.split("template", " "), lambda x, i: F.when(F.array_contains("wild", i), "*").otherwise(x)), " ")
    return out.select("id", "template", F.when(F.col("wild").isNull(), F.col("template")).otherwise(more).alias("mined"), "n", "alone")


def judged(templates: DataFrame) -> DataFrame:
    """(id, verdict) of counted templates, BAD or CONTENT; those that are neither are left out.

    All templates are mined, and each mined template is judged once.
    """
    weights = judge_weights()

    def judge(texts: pd.Series, alone: pd.Series) -> pd.Series:
        return pd.Series([verdict(t, a, weights) for t, a in zip(texts, alone)], dtype="int32")

    own = once(mined(templates).select("id", "mined", "n", "alone", F.xxhash64("mined").alias("form")))
    once_each = own.groupBy("form", "mined").agg((F.sum("alone") / F.sum("n")).alias("share"))
    # not called deterministic, else the filter would have each template judged twice
    said = once_each.select("form", F.pandas_udf(judge, "int").asNondeterministic()("mined", "share").alias("verdict")).filter(F.col("verdict") != CHROME)
    # both sides are exchanges, so that a hot form's rows are parted at run time
    return own.select("id", "form").join(said, "form").select("id", "verdict")


def residue_bodies(df: DataFrame, key: str, text: str, encoding: str, mimetype: str) -> DataFrame:
    """(key) of the responses that are template residue, filler, an error message or a demand for scripts.

    Null, empty and blank bodies, images, fonts and bodies without text for a reader are none.  Repeated rows are judged row by
    row; other columns of ``df`` aren't read.  Bodies are read once; what follows moves ids of 64 bits.  Verdicts of content are
    fetched only for bodies that have a message.
    """
    parts = once(_taken_apart(df, key, text, encoding, mimetype))
    templates = once(counted(parts.filter("id is not null").select("id", "template", "n", "alone")))
    verdicts = once(judged(templates))
    records = parts.filter("id is null").select(F.monotonically_increasing_id().alias("_row"), key, "slot", "ids", "hidden")
    plain = records.filter("not slot")
    # both sides of these joins are exchanges, so that a hot template's rows are parted at run time if the other side is no broadcast
    shown = plain.select("_row", F.explode(F.array_union("ids", "hidden")).alias("id"))
    bad = shown.join(verdicts.filter(F.col("verdict") == BAD).select("id"), "id", "left_semi").select("_row").distinct()
    suspects = once(plain.join(bad, "_row", "left_semi").select("_row", key, "ids"))
    read = suspects.select("_row", F.explode("ids").alias("id"))
    content = read.join(verdicts.filter(F.col("verdict") == CONTENT).select("id"), "id", "left_semi").select("_row").distinct()
    return records.filter("slot").select(key).unionByName(suspects.join(content, "_row", "left_anti").select(key))


def is_residue_status(status: Column) -> Column:
    """Whether a status says anything but mapped or skipped; null and blank don't."""
    s = F.lower(strip(F.coalesce(status, F.lit(""))))
    return (s != "") & ~s.isin("mapped", "skipped")


def without_residue(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``df`` without the rows whose key is found."""
    return df.join(found.select(F.col(found.columns[0]).alias("_found")), F.col(key) == F.col("_found"), "left_anti")
