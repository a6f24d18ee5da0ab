"""Personal information in free text, found and replaced by typed placeholders (problem 3).

A skip-chain conditional random field over tokens.  A node is a word that may be (part of) a name, with the labels outside, begin and
inside; or a number, a mail address or a street address, which are tokens of their own with the labels outside and their kind.
Words with a capital are nodes wherever they stand; so are lexicon words in small letters, small-letter words beside such or behind a
word that the field has learnt to go before names, and small-letter repeats of what it takes for a name.  All other words are outside.

Potentials are log-linear: shape, letters, lexicon and context of a node; a chain potential between neighbours by the gap between
them; a skip potential between all places of a document with the same word, or with words of one stem, and between equal numbers.  A
group of such places is one factor with a hidden state of its own, so its messages are linear in its places and exact at any number
of them.  Loopy belief propagation runs the chains forward and backward and passes the groups' messages until nothing moves.

The chain's weights are maximum likelihood on texts made by ``personal_text``; those of the skips are chosen by likelihood on texts in
which names come again.  No row of a table is learnt from.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import inspect
import json
import math
import os
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.body import decode_body
from tracewell.llm.garbled import is_media
from tracewell.llm.personal_text import BOTH, Maker, unmark

KINDS = ("email", "phone", "id_number", "address", "person")
#: Texts made for training, texts with repeats for the skips' weights, and the seed; passes over the texts, chains of a step, its rate,
#: and the penalty of large weights.
TRAIN_TEXTS, SKIP_TEXTS, SEED, EPOCHS, BLOCK, RATE, PENALTY = 24_000, 600, 7, 22, 400, 0.3, 0.05
#: Probability of being outside from which on a token is no item.
OUTSIDE = 0.6
#: Change of a message (log odds) under which the field has settled.
SETTLED = 1e-2
#: Log odds under which a node can't become an item by any message: such nodes are left out of groups and chains.
HOPELESS = -5.0
#: Log odds of an unknown small-letter word behind a word from which on the latter is watched.
CUE = 0.0
#: Names are rarer in pages than in the texts made for training, above all as words that no lexicon has: taken from the log odds of a
#: name's first word, and of one outside the lexicon.
RARER, UNKNOWN = 0.0, 1.5
#: What fits a street grammar is an address more often in pages than in the made texts: added to its log odds.
STREET = 2.0
#: Times that an ending of a word must be in training to count.
ENDINGS = 150
#: Share of names among what comes again in the texts that the skips' weights are chosen on.
NAMES = 0.08
#: Tokens from which on a chain in training is cut where two are outside.
CUT = 6
#: The most, in log odds, that the potential of two neighbours adds where a name goes on.
JOINED = 4.0
#: Neighbours further apart than this many characters share no potential: their labels say nothing of each other.
APART = 60
#: Trained weights.
WEIGHTS = os.path.join(os.path.dirname(__file__), "personal_weights.json.gz")
#: Entries of a worker's memory of potentials; results don't depend on it.
KEPT = 400_000

# --- escapes -----------------------------------------------------------------------------------------------------------------

_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[nrtbf\"\\/]|&#?\w{2,8};")
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": " ", "f": " "}


def _escaped(e: str) -> str:
    if e[0] == "&":
        return html.unescape(e)
    if e[1] == "u":
        raw = "".join(chr(int(x, 16)) for x in re.findall(r"u(....)", e))
        return raw.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return _PLAIN.get(e[1], e[1])


class Text:
    """A body with its escapes read, and places back in the body."""

    def __init__(self, body: str):
        self.starts, self.shifts = [0], [0]
        if "\\" not in body and "&" not in body:
            self.text = body
            return
        parts, at, out = [], 0, 0
        for m in _ESCAPE.finditer(body):
            value = _escaped(m[0])
            if value == m[0]:
                continue
            parts += [body[at : m.start()], value]
            out += m.start() - at
            for k in range(1, len(value)):  # inside an escape every character stands at its start
                self.starts.append(out + k)
                self.shifts.append(m.start() - out - k)
            out += len(value)
            at = m.end()
            self.starts.append(out)
            self.shifts.append(at - out)
        self.text = "".join([*parts, body[at:]])

    def place(self, i: int) -> int:
        return i + self.shifts[bisect_right(self.starts, i) - 1]


# --- tokens ------------------------------------------------------------------------------------------------------------------


def _class(kinds: tuple[str, ...]) -> str:
    """Characters of Unicode categories as the inside of a character class."""
    codes = [c for c in range(0x41, 0x2FA0) if unicodedata.category(chr(c)) in kinds]
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(re.escape(chr(codes[i])) + (f"-{re.escape(chr(codes[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


_UP = _class(("Lu", "Lt"))
_CAP = f"[{_UP}]"
#: A word, with what hyphens and apostrophes join; one that begins with a capital.
_REST = r"[^\W\d_]*+(?:['’-][^\W\d_]++)*+"
_WORD = re.compile(r"[^\W\d_]" + _REST)
_CAPITAL = re.compile(rf"(?<![\w@/-]){_CAP}{_REST}(?![\d_@/])")
#: Small words inside names.
_PARTICLE_WORDS = frozenset("van von der den de del della da di dos das la le du bin ibn al el ten ter vom zu zur af av".split())
_PARTICLES = re.compile(r"(?:(?:" + "|".join(sorted(_PARTICLE_WORDS)) + r") )+\Z")
#: Particles that begin a name where they stand before its first word; the Romance ones may be prepositions.
_LEADING = re.compile(r"(?<!\w)(?:(?:van der|van den|van de|van|von der|von|vom|ten|ter|bin|ibn) )\Z", re.I)
_DIGITS = re.compile(r"\d+")
_CHUNK = re.compile(r"[^\W_]+|[\W_]+")
_SUB = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")

_AT = re.compile(r"@|%40|＠|[\[({] ?(?:at|ät) ?[\])}]| at (?=[\w-]+(?: dot |\.)[\w])", re.I)
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )"
_DOMAIN = re.compile(rf"[ ]?([^\W_][\w-]*+(?:{_DOT}[^\W_][\w-]*+)*?{_DOT}([^\W\d_][^\W_]*+(?:-[^\W_]++)*+))(?!{_DOT}[^\W_])", re.I)
_LOCAL_SIGNS = frozenset("._+'-")
#: Endings of files, which no mail address has.
_FILES = frozenset("png jpg jpeg gif webp svg css js html woff woff2 ico json php".split())
#: How numbers are written in numbering plans and in identity documents; what a number is its context says.
_SHAPES = (
    ("trunk0", r"\+\d{1,3}[ .-]?\(0\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"),
    ("us1", r"\+1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"),
    ("two4", r"\+\d{3}[ .-]\d{4}[ .-]\d{4}"),
    ("three3", r"\+\d{2,3}(?:[ .-]\d{3}){3}"),
    ("plus", r"\+\d{9,14}"),
    ("intl", r"\+\d{1,3}(?:[ .-]\d{2,5}){2,5}"),
    ("area3", r"(?:8 )?\(\d{2,4}\) ?\d{3}[-. ]\d{2}[-. ]?\d{2}"),
    ("cpf", r"\d{3}\.\d{3}\.\d{3}-\d{2}"),
    ("three34", r"\d{3}(?P<sign>[-. ])\d{3}(?P=sign)\d{4}"),
    ("pairs", r"0\d(?P<gap>[ .-])\d\d(?P=gap)\d\d(?P=gap)\d\d(?P=gap)\d\d"),
    ("uk", r"0\d{4} \d{6}|0\d{4} \d{3} \d{3}"),
    ("area", r"0\d{2} \d{4} \d{4}|0\d{2} \d{5} \d{3}|0\d{2} \d{3} \d{4}|0\d{2,3} \d{6,8}"),
    ("au", r"0\d{3}[- ]\d{3}[- ]\d{3}"),
    ("zeros", r"00\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}|00\d{2,3}(?:[ -]\d{2,4}){2,4}|00\d{9,13}"),
    ("trunk", r"0\d{9,10}"),
    ("fours", r"\d{4} \d{4} \d{4}"),
    ("threes", r"\d{3}(?P<tie>[ -])\d{3}(?P=tie)\d{3}"),
    ("ssn", r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"),
    ("hetu", r"\d{6}[-+A]\d{3}[0-9A-Z]"),
    ("slash", r"\d{6}/\d{3,4}"),
    ("fiscal", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"),
    ("letters", r"[A-Z]{2}\d{7}|[A-Z]\d{8}|[A-Z]{2}\d{6}[A-Z]|[XYZ]\d{7}[A-Z]|\d{8}[A-Z]|\d{2}[A-Z]{2}\d{5}|[A-Z]\d{7}"),
    ("six5", r"\d{6}-\d{4,5}"),
    ("digits13", r"\d{13}"),
    ("digits11", r"\d{11}"),
    ("digits10", r"\d{10}"),
    ("digits9", r"\d{9}"),
)
_NUMBER = re.compile(
    r"(?<![\w.,/-])(?:" + "|".join(f"(?P<{name}>{shape})" for name, shape in _SHAPES) + r")(?![\w]|[-/]\d|\.\d)(?:,? ?(?:x|ext\.?|#) ?\d{1,5}\b)?"
)
_NUMBER_START = re.compile(r"(?<![\w.,/-])(?:[+(]?\d(?=[\dA-Z ().-])|[A-Z]{1,6}\d)")

_NO = r"\d{1,5}(?: ?(?:bis|ter|[a-zA-Z]\b))?"
_NAME = rf"{_CAP}[\w'’-]*+"
#: Words for streets by the way an address is written, and its grammar: number, name, word; number, word, name; word,
#: name, number; name with the word as its ending, number; name, word, number.
_STREETS = (
    ("street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|terrace|court|ct|place|pl|square|sq|way|crescent|boulevard|blvd|row|gardens|grove|mews|parade|walk|hill|park|quay",
     rf"{_NO},? (?:{_NAME} )+(?:{{words}})\b\.?"),
    ("rue|avenue|boulevard|bd|place|allée|chemin|impasse|quai|cours|route|square|passage", rf"{_NO},? (?:{{words}}) (?:du |de la |de l['’]|des |de |d['’])?{_NAME}"),
    ("calle|c/|avenida|avda.|avda|plaza|paseo|camino|carrer|rua|praça|travessa|via|viale|piazza|corso|largo|vicolo|strada|bulevardul|aleea",
     rf"(?:{{words}}) ?(?:(?:del|de la|de los|de las|de|della|dei|do|da|dos|das|di) )?{_NAME}(?: (?:de |la |da |do )?{_NAME})*,? (?:n[ºo°.]+ ?|nr\.? ?)?\d{{{{1,5}}}}"),
    ("straße|strasse|str.|weg|platz|gasse|allee|damm|ufer|ring|straat|laan|plein|gracht|kade|gatan|vägen|gränd|gata|gate|vej|veien|gade|katu|tie|kuja|polku|raitti",
     rf"{_CAP}[\w-]*?(?:{{words}}) \d{{{{1,5}}}}(?: ?[a-zA-Z]\b)?(?: \d{{{{1,3}}}}\b)?"),
    ("straße|str.|weg|platz|allee|tn|tänav|tee|pst|puiestee|mnt|maantee|utca|út|tér|caddesi|cad.|sokak|sok.|bulvarı", rf"{_NAME}(?: {_NAME})* (?:{{words}})\.? \d{{{{1,5}}}}(?:-\d{{{{1,4}}}}| ?[a-z]\b)?"),
    ("ul.|ulica|al.|aleja|pl.|plac|os.|ulice|nám.|náměstí|trg", rf"(?:{{words}}) ?(?:{_NAME} )+\d{{{{1,5}}}}(?:[/ ]\d{{{{1,4}}}})?"),
    ("ул.|улица|пр.|пр-т|проспект|пер.|переулок|наб.|набережная|шоссе|бульвар|площадь|вул.", rf"(?:{{words}}) ?{_NAME}(?:[ -]{_NAME})*,? (?:д(?:\.|ом)? ?)?\d{{{{1,5}}}}(?:,? ?кв\.? ?\d{{{{1,4}}}})?"),
)


def _street_patterns() -> list[tuple[list[str], re.Pattern]]:
    out = []
    for words, grammar in _STREETS:
        listed = sorted(words.split("|"), key=len, reverse=True)
        forms = "|".join(f"[{w[0].upper()}{w[0]}]{re.escape(w[1:])}" for w in listed)
        out.append((listed, re.compile(r"(?<!\w)" + grammar.replace("{{words}}", "{words}").replace("{words}", forms).replace("{{", "{").replace("}}", "}"))))
    return out


#: Grammars that begin with capitalised words or a word before them: their matches from neighbouring starts run over the same words.
_RUNNING = {2, 4, 5, 6}
_RUN = re.compile(rf" ?(?:(?:del|de la|de los|de las|de|della|dei|do|da|dos|das|di) )?{_NAME}(?:[ -](?:de |la |da |do )?{_NAME})*+ ?")
_PLAIN_RUN = re.compile(rf"{_NAME}(?: {_NAME})*+")


def street_matches(t: str, n: int, pattern: re.Pattern) -> Iterator[re.Match]:
    """Matches of a grammar.  Where a start fails, all starts in the same run of words would fail too, so each run is read once."""
    if n not in _RUNNING:
        yield from pattern.finditer(t)
        return
    at = 0
    for begin in _street_starts(n).finditer(t):
        if begin.start() < at:
            continue
        if m := pattern.match(t, begin.start()):
            yield m
            at = m.end()
        else:
            run = _PLAIN_RUN.match(t, begin.start()) if n == 4 else _RUN.match(t, begin.end())
            at = run.end() if run else begin.end()


@lru_cache(maxsize=None)
def _street_starts(n: int) -> re.Pattern:
    if n == 4:
        return re.compile(rf"(?<!\w){_CAP}")
    words = sorted(_STREETS[n][0].split("|"), key=len, reverse=True)
    return re.compile(r"(?<!\w)(?:" + "|".join(f"[{w[0].upper()}{w[0]}]{re.escape(w[1:])}" for w in words) + ")")


def _lower(t: str) -> str:
    """Small letters, each in its place."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def _sound(word: str) -> bool:
    """Whether a word with letters outside ASCII is written as words are; text read with a wrong encoding isn't."""
    return all(p.isalpha() and (p.istitle() or p.isupper() or p.islower()) for p in re.split("['’-]", word) if p)


#: Signs outside ASCII that correct text has right beside a word.
_BESIDE_WORDS = frozenset("’‘“”„«»‹›–—…¡¿\xa0\u200b\u2009\u202f•·。、，！？：；（）「」")


def _alone(t: str, a: int, b: int) -> bool:
    """Whether no strange sign stands right beside a word."""
    before, behind = t[a - 1 : a] if a else "", t[b : b + 1]
    return (before <= "\x7f" or before.isalpha() or before in _BESIDE_WORDS) and (behind <= "\x7f" or behind.isalpha() or behind in _BESIDE_WORDS)


class Node:
    """A token that may be an item: ``kind`` is word, number, email or address."""

    __slots__ = ("kind", "start", "end", "odds")

    def __init__(self, kind: str, start: int, end: int, odds: tuple[float, float]):
        self.kind, self.start, self.end = kind, start, end
        self.odds = odds  # of the two labels against outside


LABELS = {"number": ("", "phone", "id_number"), "email": ("", "email"), "address": ("", "address"), "word": ("", "person", "person")}
_JOINS = frozenset(("space", "comma", "dot", "particle", "hyphen"))


@lru_cache(maxsize=20_000)
def gap_class(gap: str) -> str:
    """What stands between two tokens."""
    if gap in _GAPS:
        return _GAPS[gap]
    if len(gap) > 24:
        return "far"
    if _PARTICLES.match(gap.lstrip(" ,")):
        return "particle"
    if any(c.isalnum() for c in gap):
        return "words"
    bare = gap.strip(" \t")
    if re.fullmatch(r'\\?"\s*:\s*\\?"', bare):
        return "key"
    if "<" in gap or ">" in gap:
        return "angle" if bare in ("<", ">") else "tag"
    if "\n" in gap or "\r" in gap:
        return "line"
    if '"' in gap or "{" in gap or "[" in gap:
        return "quote"
    if "." in gap or "!" in gap or "?" in gap:
        return "stop"
    return {":": "colon", "=": "equals", "(": "open", ")": "close", ";": "semi", "/": "slash", "-": "dash", "–": "dash", "—": "dash", "": "space"}.get(bare, "sign")


_GAPS = {"": "tight", " ": "space", "\xa0": "space", ", ": "comma", ",": "comma", ". ": "dot", ".": "dot", "-": "hyphen", ": ": "colon", "=": "equals", " (": "open", ") ": "close"}


class Tokens:
    """The nodes of texts, and the features of each."""

    def __init__(self, lexicon: dict[str, str]):
        """``lexicon``: name in small letters to its parts, g for given and f for family."""
        self.part: dict[str, str] = dict(lexicon)
        for name, part in lexicon.items():  # names of several words are known by their last
            if " " in name:
                self.part.setdefault(name.rsplit(" ", 1)[1], part)
        self.streets = _street_patterns()
        tags: dict[str, list] = defaultdict(list)
        for name in self.part:
            if " " not in name:
                tags[name].append(("name", 0))
        for n, (words, _) in enumerate(self.streets):
            for w in words:
                tags[(" " if n in (0, 1, 4) else "") + w + (" " if n in (1, 3) or (n in (2, 5, 6) and w[-1].isalpha()) else "")].append(("street", n))
        self._tags = tags
        self.watch({})

    def watch(self, cues: dict[str, float]) -> None:
        """Also looks for words that go before names in small letters."""
        self.words = ahocorasick.Automaton()
        tags = {k: list(v) for k, v in self._tags.items()}
        for cue in cues:
            tags.setdefault(cue, []).append(("cue", 0))
        for word, of in tags.items():
            self.words.add_word(word, (len(word), tuple(of)))
        self.words.make_automaton()

    def lexicon_of(self, word: str) -> str:
        p = self.part.get(word, "")
        if not p and "-" in word:
            p = "".join(sorted({c for w in word.split("-") for c in self.part.get(w, "")}))
        return p

    @staticmethod
    def _emails(t: str) -> Iterator[tuple[int, int, str, str]]:
        last = 0
        for m in _AT.finditer(t):
            end = m.start()
            spaced = end > last and t[end - 1] == " "
            begin = end = end - spaced
            while begin > last and (t[begin - 1].isalnum() or t[begin - 1] in _LOCAL_SIGNS):  # each character once, as local parts don't overlap
                begin -= 1
            while begin < end and not t[begin].isalnum():
                begin += 1
            right = _DOMAIN.match(t, m.end())
            if begin >= end or not right:
                last = m.end()
                continue
            if m[0].lower() == " at " and " dot " not in right[0].lower():
                continue
            sign = "@" if m[0] in "@＠" else "%40" if m[0] == "%40" else "word"
            digits = sum(c.isdigit() for c in right[1])
            shape = f"{sign}{'_' if spaced else ''}|{'file' if right[2].lower() in _FILES else 'version' if digits > len(right[1]) - digits - right[1].count('.') else 'host'}"
            last = right.end()
            yield begin, right.end(), "email", shape

    @staticmethod
    def _numbers(t: str) -> Iterator[tuple[int, int, str, str]]:
        at = 0
        for begin in _NUMBER_START.finditer(t):
            i = begin.start()
            if i < at or not (m := _NUMBER.match(t, i) or (t[i] in "+(" and _NUMBER.match(t, i + 1))):
                continue
            at = m.end()
            start = m.start()
            while not t[start].isalnum():
                start += 1
            yield start, m.end(), "number", next(n for n, _ in _SHAPES if m[n] is not None)

    def _addresses(self, t: str, kinds: set[int]) -> Iterator[tuple[int, int, str, str]]:
        found = sorted((m.start(), -m.end(), n) for n in kinds for m in street_matches(t, n, self.streets[n][1]))
        last = -1
        for a, b, n in found:
            if a >= last:
                last = -b
                yield a, last, "address", str(n)

    def spans(self, t: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, shape) of a text's tokens in order, without overlap."""
        low = _lower(t)
        lexicon, streets, cued = [], set(), []
        for end, (size, of) in self.words.iter(low):
            a, b = end + 1 - size, end + 1
            for kind, n in of:
                if kind == "street":
                    if n not in streets and (
                        not low[b : b + 1].isalnum() if n == 0 else low[b : b + 1].isdigit() if n == 3 else low[b : b + 3].lstrip(". ")[:1].isdigit() if n == 4 else n == 1 or not (a and low[a - 1].isalnum())
                    ):
                        streets.add(n)
                elif (a and (low[a - 1].isalnum() or low[a - 1] in "_@")) or (b < len(low) and (low[b].isalnum() or low[b] in "_@")):
                    continue
                elif kind == "name":
                    if not t[a].isupper():
                        lexicon.append((a, b))
                else:
                    cued.append(b)
        out = sorted([*self._emails(t), *self._numbers(t)])
        if streets and (found := list(self._addresses(t, streets))):
            # of a number and an address that overlap the longer one holds
            starts = [c[0] for c in out]
            near = lambda c: out[max(0, bisect_right(starts, c[0]) - 1) : bisect_right(starts, c[1])]
            found = [c for c in found if not any(x[1] > c[0] and x[1] - x[0] > c[1] - c[0] for x in near(c))]
            begins = [c[0] for c in found]
            out = sorted([c for c in out if not ((i := bisect_right(begins, c[0])) and found[i - 1][1] > c[0])] + found)
        words = {m.start(): m.end() for m in _CAPITAL.finditer(t) if (m[0].isascii() or _sound(m[0])) and _alone(t, m.start(), m.end())}
        for a, b in lexicon:
            if a not in words and (a == 0 or t[a - 1] not in "'’-/#") and t[b : b + 1] not in ("/", "="):
                end = words[a] = _WORD.match(t, a).end() if t[b : b + 1] in ("-", "'", "’") else b
                # small letters beside a lexicon word in small letters
                if t[end : end + 1] == " " and (m := _BESIDE.match(t, end + 1)) and m[0].islower():
                    words.setdefault(m.start(1), m.end(1))
                if a and t[a - 1] == " " and (m := _BEFORE_IT.search(t, max(0, a - 40), a - 1)) and m[0].islower():
                    words.setdefault(m.start(), m.end())
        for b in cued:
            if (m := _AFTER_CUE.match(t, b)) and m[1].islower():
                words.setdefault(m.start(1), m.end(1))
                if m[2] and m[2].islower():
                    words.setdefault(m.start(2), m.end(2))
        if not out:
            every = [(a, words[a], "word", "") for a in sorted(words)]
        else:
            every, i = [], 0
            for a in sorted(words):
                while i < len(out) and out[i][1] <= a:
                    i += 1
                if i == len(out) or out[i][0] >= words[a]:
                    every.append((a, words[a], "word", ""))
            every = sorted(every + out)
        clean, at = [], -1
        for c in every:
            if c[0] >= at:
                clean.append(c)
                at = c[1]
        return clean

    # features of a token, of the text just before it, and of the text just behind it

    def word_class(self, word: str) -> str:
        """A word's parts in the lexicon and its shape."""
        shape = "i" if len(word) == 1 else "U" if word.isupper() else "l" if word.islower() else "T" if word[1:].islower() or "-" in word or "'" in word or "’" in word else "m"
        return self.lexicon_of(word.lower()) + shape

    def word_features(self, word: str) -> list[str]:
        low, cls = word.lower(), self.word_class(word)
        f = ["w", f"s={cls[-1]}", f"x={cls[:-1]}", f"id={low}", f"n={min(len(low), 9)}"]
        if len(cls) == 1:  # an ending counts where training has it often (see ``train_chain``)
            f.append(f"z={low[-3:]}")
        return f

    @staticmethod
    def parts(left: str, right: str) -> tuple[str, str, str, str, str]:
        """Word before last, last word and gap before a token; gap and word behind it."""
        before = _CHUNK.findall(left)
        gap = before.pop() if before and not before[-1][-1].isalnum() else ""
        p1 = before.pop() if before else "^"
        p2 = before[-2].lower() if len(before) >= 2 and len(before[-1]) <= 2 else ""
        behind = _CHUNK.findall(right)
        after = behind.pop(0) if behind and not behind[0][0].isalnum() else ""
        return p2, p1, gap, after, behind[0] if behind else "$"

    def around(self, own: str, p2: str, p1: str, gap: str, after: str, n1: str) -> list[str]:
        """Features of the ``parts`` around a token whose class or shape is ``own``."""
        g, h = gap_class(gap), gap_class(after)
        if g == "dot" and len(p1) > 3 or (g == "dot" and p1[0].islower()):
            g = "stop"
        if h == "dot" and own[-1:] != "i":
            h = "stop"
        near = self.word_class(p1) if len(gap) < 3 and p1[0].isalpha() else ""
        near = near if near[-1:] in "TU" or len(near) > 1 else ""
        next_ = self.word_class(n1) if len(after) < 3 and n1[0].isalpha() else ""
        next_ = next_ if next_[-1:] in "TU" or len(next_) > 1 else ""
        f = [f"k={w.lower()}" for w in _SUB.findall(p1)] if g in ("key", "equals") or "_" in gap or not (p1.islower() or p1[1:].islower()) else []
        p1 = "0" if p1[0].isdigit() else p1.lower()
        n1 = "0" if n1[0].isdigit() else n1.lower()
        f += [f"g={g}", f"p={p1}", f"p={p1}|{g}", f"h={h}", f"q={n1}", f"q={n1}|{h}", f"o={own}|{g}", f"o={own}|{h}", f"o={own}|{g}|{h}", f"op={own}|{p1}", f"oq={own}|{n1}", f"ob={own}|{near}|{g}", f"on={own}|{next_}|{h}", f"obn={own}|{near}|{next_}"]
        if p2:
            f.append(f"pp={p2} {p1}")
        return f

    def features(self, kind: str, shape: str, left: str, word: str, right: str) -> list[str]:
        if kind == "word":
            return self.word_features(word) + self.around(self.word_class(word), *self.parts(left, right))
        f = [f"o={shape}", *self.around(shape, *self.parts(left, right))]
        if kind == "number":  # how its digits are parted, and what it begins with
            sizes = _DIGITS.sub(lambda m: str(len(m[0])), word.partition("x")[0].partition("e")[0].strip(" ,"))
            lead = "+" if left.endswith("+") else "(" if left.endswith("(") else ""
            f += [f"d={lead}{sizes}", f"d={lead}{sizes}|{word[0]}", f"b={lead}{word[:2]}"]
        return [f"{kind}:{x}" for x in f]


#: Characters before and behind a token that its features are made of.
LEFT, RIGHT = 28, 14
_BESIDE = re.compile(r"(?:(?:van|der|von|de) )*([^\W\d_]" + _REST + ")")
_BEFORE_IT = re.compile(r"(?<![\w'’-])[^\W\d_]++(?:['’-][^\W\d_]++)*+\Z")
_AFTER_CUE = re.compile(r"(?:\"?[:=] ?\"?| |: ?|, |,\s+)([^\W\d_]" + _REST + r")(?: ([^\W\d_]" + _REST + r"))?")

# --- the field ---------------------------------------------------------------------------------------------------------------


class Field:
    """Weights of the potentials, their sums kept by a worker, and belief propagation."""

    def __init__(self, weights: dict[str, tuple[float, float]], edges: dict[tuple[str, str, str], np.ndarray], skips: dict[str, tuple[float, float, float]], lexicon: dict[str, str]):
        self.weights, self.edges, self.skips = weights, {k: [[math.exp(x) for x in row] for row in v.tolist()] for k, v in edges.items()}, skips
        self.tokens = Tokens(lexicon)
        self.kept: dict[tuple | str, tuple] = {}
        self.flat = {True: [[1.0, 1.0, 0.0]] * 3, False: [[1.0] * 3] * 3}  # where training had no such pair: a word is inside only behind one that is
        # words that make a small-letter word behind them worth a look
        small = self._sum(("w", "s=l", "x="))[0]
        cues = {}
        for f, (b, _) in weights.items():
            if f.startswith("p=") and "|" not in f and len(f) > 3:
                best = max(self._sum((f, f"{f}|{g}", f"g={g}", f"o=l|{g}", f"op=l|{f[2:]}"))[0] for g in ("space", "colon", "key", "equals", "comma"))
                if small + best > CUE:
                    cues[f[2:]] = best
        self.tokens.watch(cues)

    def _sum(self, features: Iterable[str]) -> tuple[float, float]:
        a = b = 0.0
        get = self.weights.get
        for f in features:
            if w := get(f):
                a += w[0]
                b += w[1]
        return a, b

    def _word(self, word: str, left: str, right: str) -> tuple[float, float]:
        """Log odds of a word: of itself, and of what is around it; the sums of both are kept too."""
        kept, tokens = self.kept, self.tokens
        if (own := kept.get(word)) is None:
            own = kept[word] = (*self._sum(tokens.word_features(word)), tokens.word_class(word))
        parts = tokens.parts(left, right)
        if (more := kept.get((own[2], *parts))) is None:
            more = kept[(own[2], *parts)] = self._sum(tokens.around(own[2], *parts))
        return own[0] + more[0], own[1] + more[1]

    def nodes(self, t: str, spans: list[tuple[int, int, str, str]]) -> list[Node]:
        """The tokens that may be items, with the log odds of their own potentials.  Odds follow from a token and a little text around it; a worker keeps them."""
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        every = []
        for a, b, kind, shape in spans:
            left, right = t[a - LEFT if a > LEFT else 0 : a] or "\n", t[b : b + RIGHT] or "\n"  # a text's ends are ends of lines
            key = (left, t[a:b], right, shape)
            if (odds := kept.get(key)) is None:
                odds = kept[key] = self._word(key[1], left, right) if kind == "word" else self._sum(self.tokens.features(kind, shape, left, key[1], right))
            every.append(odds)
        # the most that a name can have which begins at a word, and which goes on with it
        out, begin, on, after = [], [0.0] * len(every), 0.0, -1
        for i in range(len(every) - 1, -1, -1):
            a, b, kind, _ = spans[i]
            more = max(0.0, JOINED + on) if kind == "word" and 0 <= after - b < 14 else 0.0
            begin[i] = max(every[i]) if kind != "word" else every[i][0] + more
            on, after = (every[i][1] + more, a) if kind == "word" else (0.0, -1)
        for (a, b, kind, _), odds, most in zip(spans, every, begin):
            if most >= HOPELESS or (kind == "word" and odds[1] >= HOPELESS and out and out[-1].kind == "word" and a - out[-1].end < 14):
                out.append(Node(kind, a, b, odds))
        return out

    def edge(self, a: Node, b: Node, t: str) -> list[list[float]] | None:
        """Potentials between two neighbours; None if they are too far apart to say anything of each other."""
        if b.start - a.end > APART:
            return None
        return self.edges.get((a.kind, b.kind, gap_class(t[a.end : b.start])), self.flat[b.kind == "word"])

    # Beliefs: for each node three numbers that sum to 1.

    @staticmethod
    def _chain(nodes: list[list[float]], edges: list[list[list[float]]]) -> list[list[float]]:
        """Marginals of a chain, forward and backward."""
        n = len(nodes)
        if n == 1:
            s = sum(nodes[0])
            return [[x / s for x in nodes[0]]]
        ahead = [nodes[0]]
        for i in range(1, n):
            p, e, u = ahead[-1], edges[i - 1], nodes[i]
            x0 = (p[0] * e[0][0] + p[1] * e[1][0] + p[2] * e[2][0]) * u[0]
            x1 = (p[0] * e[0][1] + p[1] * e[1][1] + p[2] * e[2][1]) * u[1]
            x2 = (p[0] * e[0][2] + p[1] * e[1][2] + p[2] * e[2][2]) * u[2]
            s = x0 + x1 + x2
            ahead.append([x0 / s, x1 / s, x2 / s])
        out = [ahead[-1]]
        back = [1.0, 1.0, 1.0]
        for i in range(n - 2, -1, -1):
            e, u = edges[i], nodes[i + 1]
            v0, v1, v2 = back[0] * u[0], back[1] * u[1], back[2] * u[2]
            b0, b1, b2 = (e[k][0] * v0 + e[k][1] * v1 + e[k][2] * v2 for k in range(3))
            s = b0 + b1 + b2
            back = [b0 / s, b1 / s, b2 / s]
            a = ahead[i]
            y0, y1, y2 = a[0] * back[0], a[1] * back[1], a[2] * back[2]
            s = y0 + y1 + y2
            out.append([y0 / s, y1 / s, y2 / s])
        out.reverse()
        s = sum(out[-1])
        out[-1] = [x / s for x in out[-1]]
        return out

    def infer(self, t: str, nodes: list[Node]) -> list[list[float]]:
        """Marginals of the nodes' labels by loopy belief propagation."""
        beliefs = [[1.0, 0.0, 0.0] for _ in nodes]
        chains: list[tuple[list[int], list]] = []
        for i, c in enumerate(nodes):
            joined = None
            if chains and chains[-1][0][-1] == i - 1:
                joined = self.edge(nodes[i - 1], c, t)
            if joined is None:
                chains.append(([i], []))
            else:
                chains[-1][0].append(i)
                chains[-1][1].append(joined)
        own: dict[int, list[float]] = {}
        for ids, _ in chains:
            for n, i in enumerate(ids):
                a, b = nodes[i].odds
                words = nodes[i].kind == "word"
                own[i] = [1.0, math.exp(min(a, 30.0)), 0.0 if (words and n == 0) or LABELS[nodes[i].kind][-1] == LABELS[nodes[i].kind][1] and not words else math.exp(min(b, 30.0))]
        for ids, edges in chains:
            for i, m in zip(ids, self._chain([own[i] for i in ids], edges)):
                beliefs[i] = m
        groups = self._groups(t, nodes, own, beliefs)
        if not groups:
            return beliefs
        of_node: dict[int, list[int]] = defaultdict(list)
        for g, (_, members) in enumerate(groups):
            for i in members:
                of_node[i].append(g)
        touched = [(ids, edges) for ids, edges in chains if any(i in of_node for i in ids)]
        sent = [{i: 0.0 for i in members} for _, members in groups]  # log odds from group to place
        damp, n = 0.7, 0
        while True:
            moved = 0.0
            for g, (weight, members) in enumerate(groups):
                w1, w0, rare = math.exp(weight[0]), math.exp(weight[1]), weight[2]
                votes = {}
                for i in members:
                    m = beliefs[i]
                    odds = max(1e-12, 1 - m[0]) / max(1e-12, m[0]) * math.exp(-sent[g][i])
                    # what a place says to the hidden state: item against none
                    votes[i] = math.log((1 + odds * w1) / (w0 + odds))
                total = sum(votes.values())
                for i in members:
                    x = math.exp(max(-30.0, min(30.0, total - votes[i] - rare)))
                    new = math.log((1 + x * w1) / (w0 + x))
                    step = damp * (new - sent[g][i])
                    moved = max(moved, abs(new - sent[g][i]))
                    sent[g][i] += step
            for ids, edges in touched:
                local = []
                for i in ids:
                    u = own[i]
                    if i in of_node:
                        r = math.exp(max(-30.0, min(30.0, sum(sent[g][i] for g in of_node[i]))))
                        u = [u[0], u[1] * r, u[2] * r]
                    local.append(u)
                for i, m in zip(ids, self._chain(local, edges)):
                    beliefs[i] = m
            n += 1
            if moved < SETTLED:
                return beliefs
            damp = 0.7 if n < 10 else 7.0 / n  # steps shrink, so that the field settles in any case
            if damp * moved < SETTLED:
                return beliefs

    def _groups(self, t: str, nodes: list[Node], own: dict, beliefs: list[list[float]]) -> list[tuple[tuple[float, float, float], list[int]]]:
        """((weight of both item, of both none, log odds against a name), places) of the words and numbers that a document has more than once."""
        by: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i in own:
            c = nodes[i]
            if c.kind == "word":
                low = t[c.start : c.end].lower()
                if len(low) > 2:
                    by[("same", low)].append(i)
                    if len(low) > 5 and not self.tokens.part.get(low):
                        by[("stem", low[: max(5, len(low) - 3)])].append(i)
            elif c.kind == "number":
                by[("number", re.sub(r"\D", "", t[c.start : c.end])[-7:])].append(i)
        out = []
        for (kind, key), members in by.items():
            if len(members) < 2 or max(1 - beliefs[i][0] for i in members) < 0.02:
                continue
            if kind == "stem" and len({t[nodes[i].start : nodes[i].end].lower() for i in members}) < 2:
                continue
            if any(self.skips[kind]):
                out.append((self.skips[kind], members))
        return out

    def items(self, t: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of a text."""
        spans = self.tokens.spans(t)
        nodes = self.nodes(t, spans)
        if not nodes:
            return []
        beliefs = self.infer(t, nodes)
        if again := self._repeats(t, spans, nodes, beliefs):
            nodes = self.nodes(t, sorted(spans + again))
            beliefs = self.infer(t, nodes)
        out: list[tuple[str, int, int]] = []
        last = -1  # of a name that goes on
        for i, (c, m) in enumerate(zip(nodes, beliefs)):
            if m[0] >= OUTSIDE:
                continue
            kind = LABELS[c.kind][1 if m[1] >= m[2] else 2]
            if c.kind == "word" and m[2] > m[1] and last == i - 1 and out and gap_class(t[nodes[i - 1].end : c.start]) in _JOINS:
                out[-1] = ("person", out[-1][1], c.end)
            else:
                start = c.start
                if c.kind == "word" and (p := _LEADING.search(t[max(0, start - 9) : start])):
                    start -= len(p[0])
                out.append((kind, start, c.end))
            last = i if c.kind == "word" else -2
        return [x for x in out if not (x[0] == "person" and x[2] - x[1] < 2)]

    def _repeats(self, t: str, spans: list[tuple[int, int, str, str]], nodes: list[Node], beliefs: list[list[float]]) -> list[tuple[int, int, str, str]]:
        """Small-letter places, so far no tokens, of words that the field takes for names outside the lexicon."""
        words = {w for c, m in zip(nodes, beliefs) if c.kind == "word" and m[0] < 0.5 and len(w := t[c.start : c.end].lower()) > 3 and w not in self.tokens.part}
        if not words:
            return []
        starts = [c[0] for c in spans]
        out = []
        for m in _WORD.finditer(t):
            a, b = m.span()
            if m[0] not in words or (a and (t[a - 1].isalnum() or t[a - 1] in "_@-")) or t[b : b + 1] in ("_", "@"):
                continue
            i = bisect_right(starts, a)
            if not ((i and spans[i - 1][1] > a) or (i < len(spans) and spans[i][0] < b)):
                out.append((a, b, "word", ""))
        return out


# --- training ----------------------------------------------------------------------------------------------------------------


def _training_chains(texts: int, seed: int) -> list:
    """Chains of tokens of made texts with features and true labels.  Every word is a token here."""
    maker, tokens = Maker(seed), Tokens({})
    chains = []
    for _ in range(texts):
        maker.known = {}
        text, gold = maker.text()
        tokens.part = dict(maker.known) | {w.lower(): "g" for w in maker.r.sample(BOTH, 20)}
        chains += _labelled(text, gold, tokens)
    return chains


def _labelled(text: str, gold: set[tuple[str, int, int]], tokens: Tokens) -> list:
    """Chains (kinds, features, labels, gaps) of a text with its items."""
    others = [c for c in tokens.spans(text) if c[2] != "word"]
    starts = [c[0] for c in others]
    spans = list(others)
    for m in _WORD.finditer(text):
        i = bisect_right(starts, m.start())
        if not ((i and others[i - 1][1] > m.start()) or (i < len(others) and others[i][0] < m.end())) and not text[max(0, m.start() - 1) : m.start()].isalnum():
            spans.append((m.start(), m.end(), "word", ""))
    spans.sort()
    items = {(k, a) for k, a, _ in gold}
    people = sorted((a, b) for k, a, b in gold if k == "person")
    begins = [a for a, _ in people]
    chains, last, inside = [], None, None
    for a, b, kind, shape in spans:
        word = text[a:b]
        if kind == "word":
            i = bisect_right(begins, a)
            of = i - 1 if i and people[i - 1][1] > a else None
            if of is not None and word in _PARTICLE_WORDS:
                continue
            y = 0 if of is None else 2 if inside == of else 1
            inside = of
        else:
            y, inside = next((n for n, k in enumerate(LABELS[kind]) if n and (k, a) in items), 0), None
        long = chains and len(chains[-1][0]) >= CUT and not y and not chains[-1][2][-1]
        if last is None or a - last[1] > APART or long:
            chains.append(([], [], [], []))
            y = 1 if y == 2 and kind == "word" else y
        else:
            chains[-1][3].append((last[2], kind, gap_class(text[last[1] : a])))
        chains[-1][0].append(kind)
        chains[-1][1].append(tokens.features(kind, shape, text[max(0, a - LEFT) : a], word, text[b : b + RIGHT]))
        chains[-1][2].append(y)
        last = (a, b, kind)
    return chains


def _gradient(W, E, hard, n, rows, cols, y, mask, e):
    """Gradient of the negative log likelihood of chains of ``n`` tokens, by forward and backward passes over all of them at once."""
    size = len(y)
    u = np.zeros((3, size * n))
    for k in (0, 1):
        u[k + 1] = np.bincount(rows, W[k][cols], size * n)
    u = u.T.reshape(size, n, 3) + mask
    p = np.exp(u - u.max(2, keepdims=True))
    f, scale = np.empty((size, n, 3)), np.empty((size, n))
    T = np.exp(np.clip(E[e], -30, 30)) * hard[e] if n > 1 else None
    for i in range(n):
        v = p[:, i] if i == 0 else (f[:, i - 1, :, None] * T[:, i - 1]).sum(1) * p[:, i]
        scale[:, i] = v.sum(1)
        f[:, i] = v / scale[:, i, None]
    back = np.ones((size, n, 3))
    for i in range(n - 2, -1, -1):
        back[:, i] = (T[:, i] * (p[:, i + 1] * back[:, i + 1])[:, None, :]).sum(2) / scale[:, i + 1, None]
    d = f * back
    at = np.arange(size)[:, None]
    d[at, np.arange(n)[None, :], y] -= 1
    flat = d.reshape(size * n, 3)
    gW = np.stack([np.bincount(cols, flat[rows, k + 1], W.shape[1]) for k in (0, 1)])
    gE = np.zeros_like(E)
    if n > 1:
        q = f[:, :-1, :, None] * T * (p[:, 1:] * back[:, 1:])[:, :, None, :] / scale[:, 1:, None, None]
        q[at, np.arange(n - 1)[None, :], y[:, :-1], y[:, 1:]] -= 1
        for i in range(3):
            for j in range(3):
                if i or j:
                    gE[:, i, j] = np.bincount(e.ravel(), q[:, :, i, j].ravel(), len(E))
    return gW, gE


def train_chain(chains: list, epochs: int = EPOCHS, penalty: float = PENALTY, seed: int = SEED):
    """Maximum likelihood of chains by adaptive gradient steps: (weights of features, weights of edges).

    Chains of one length are worked out together, in blocks.
    """
    count: dict[str, int] = defaultdict(int)
    for _, feats, _, _ in chains:
        for fs in feats:
            for f in fs:
                count[f] += 1
    names = [f for f, n in count.items() if n > (ENDINGS if f[:2] == "z=" else 1)]
    index = {f: i for i, f in enumerate(names)}
    pairs = sorted({e for c in chains for e in c[3]})
    pair_index = {e: i for i, e in enumerate(pairs)}
    allowed = np.zeros((len(pairs), 3, 3))
    for (a, b, g), i in pair_index.items():
        if b == "word":
            allowed[i, 0, 2] = -1e9
            if a != "word" or g not in _JOINS:
                allowed[i, :, 2] = -1e9
    blocks = []
    by_length: dict[int, list] = defaultdict(list)
    for c in chains:
        by_length[len(c[0])].append(c)
    parts = [(n, cs[i : i + BLOCK]) for n, cs in sorted(by_length.items()) for i in range(0, len(cs), BLOCK)]
    for n, cs in parts:
        rows = np.repeat(np.arange(len(cs) * n), [sum(f in index for f in fs) for c in cs for fs in c[1]])
        cols = np.array([index[f] for c in cs for fs in c[1] for f in fs if f in index], np.int64)
        y = np.array([c[2] for c in cs])
        mask = np.zeros((len(cs), n, 3))
        for k, c in enumerate(cs):
            for i, kind in enumerate(c[0]):
                if kind in ("email", "address") or (kind == "word" and i == 0):
                    mask[k, i, 2] = -1e9
        y[mask[np.arange(len(cs))[:, None], np.arange(n)[None, :], y] < 0] = 1
        e = np.array([[pair_index[x] for x in c[3]] for c in cs], np.int64).reshape(len(cs), n - 1)
        if n > 1:  # a chain begins anew where its first word is inside
            bad = allowed[e, y[:, :-1], y[:, 1:]] < 0
            y[:, 1:][bad] = 1
        blocks.append((n, rows, cols, y, mask, e))
    hard = np.exp(allowed)
    W, E = np.zeros((2, len(names))), np.zeros((len(pairs), 3, 3))
    sW, sE = np.full_like(W, 1e-8), np.full_like(E, 1e-8)
    share = penalty / len(blocks)
    order = np.random.default_rng(seed)
    for turn in range(epochs):
        rate = RATE * (1 - turn / epochs)
        for block in order.permutation(len(blocks)):
            n, rows, cols, y, mask, e = blocks[block]
            gW, gE = _gradient(W, E, hard, n, rows, cols, y, mask, e)
            gW += share * W
            gE += share * E
            sW += gW * gW
            sE += gE * gE
            W -= rate * gW / np.sqrt(sW)
            E -= rate * gE / np.sqrt(sE)
    W = W.T
    weights = {f: (float(a), float(b)) for f, (a, b) in zip(names, W) if abs(a) + abs(b) > 0.02}
    for f, rarer in (("w", RARER), ("x=", UNKNOWN)):
        weights[f] = (weights[f][0] - rarer, weights[f][1])
    for n in range(len(_STREETS)):
        f = f"address:o={n}"
        weights[f] = (weights.get(f, (0.0, 0.0))[0] + STREET, 0.0)
    return weights, {k: E[i] + allowed[i] for k, i in pair_index.items()}


def digest() -> str:
    """Of all that the weights follow from: the made texts, the tokens and their features, the training and its parameters."""
    from tracewell.llm import personal_text

    own = "".join(map(inspect.getsource, (Tokens.lexicon_of, Tokens._emails, Tokens._numbers, Tokens._addresses, Tokens.word_class, Tokens.word_features, Tokens.parts, Tokens.around, Tokens.features, gap_class, _gradient, train_chain, train_skips, _labelled)))
    rest = [TRAIN_TEXTS, SKIP_TEXTS, SEED, EPOCHS, BLOCK, RATE, PENALTY, RARER, UNKNOWN, STREET, NAMES, ENDINGS, CUT, APART, LEFT, RIGHT, _SHAPES, _STREETS, _CAPITAL.pattern, _GAPS]
    return hashlib.sha256((own + repr(rest) + inspect.getsource(personal_text)).encode()).hexdigest()


def fit() -> tuple:
    """(weights, edges, skips): the training, some minutes."""
    weights, edges = train_chain(_training_chains(TRAIN_TEXTS, SEED))
    weights = {f: (round(a, 3), round(b, 3)) for f, (a, b) in weights.items()}
    return weights, edges, train_skips(weights, edges, SEED + 1)


@lru_cache(maxsize=1)
def trained() -> tuple:
    """(weights, edges, skips): read from the file that ``python -m tracewell.llm.personal`` wrote, if it is of this code; else trained."""
    if os.path.exists(WEIGHTS):
        with gzip.open(WEIGHTS, "rt", encoding="utf-8") as f:
            kept = json.load(f)
        if kept["digest"] == digest():
            weights = {k: (a, b) for k, a, b in kept["weights"]}
            return weights, {tuple(k): np.array(v) for k, v in kept["edges"]}, {k: tuple(v) for k, v in kept["skips"].items()}
    return fit()


def save() -> None:
    weights, edges, skips = fit()
    with open(WEIGHTS, "wb") as raw, gzip.GzipFile("", "wb", mtime=0, fileobj=raw) as f:
        kept = {"digest": digest(), "weights": [(k, *v) for k, v in weights.items()], "edges": [(k, v.round(3).tolist()) for k, v in edges.items()], "skips": skips}
        f.write(json.dumps(kept, ensure_ascii=False, separators=(",", ":")).encode())


def train_skips(weights, edges, seed: int, texts: int = SKIP_TEXTS) -> dict[str, tuple[float, float, float]]:
    """Weights of the skips, by likelihood of the words of made texts whose names come again, each of a grid of pairs tried."""
    maker = Maker(seed)
    cases = []
    while len(cases) < texts:
        maker.known = {}
        parts = maker.again(maker.r.randint(1, 4), NAMES) + [maker.piece() for _ in range(maker.r.randint(0, 2))]
        maker.r.shuffle(parts)
        cases.append(unmark("\n".join(parts)))
    best, chosen = -1e18, (0.0, 0.0, 0.0)
    field = Field(weights, edges, {k: (0.0, 0.0, 0.0) for k in ("same", "stem", "number")}, {})
    prepared = []
    for text, gold in cases:
        nodes = field.nodes(text, field.tokens.spans(text))
        people = [(a, b) for k, a, b in gold if k == "person"]
        prepared.append((text, nodes, [any(a <= c.start < b for a, b in people) for c in nodes]))
    for w1, w0, rare in product((2.0, 3.0, 4.0, 5.0, 6.0), (0.5, 1.0, 2.0), (0.0, 1.0, 2.0, 3.0)):
        field.skips["same"] = (w1, w0, rare)
        fit = 0.0
        for text, nodes, true in prepared:
            for c, m, y in zip(nodes, field.infer(text, nodes), true):
                if c.kind == "word":
                    fit += math.log(max(1e-9, 1 - m[0] if y else m[0]))
        if fit > best:
            best, chosen = fit, (w1, w0, rare)
    return {"same": chosen, "stem": (chosen[0] / 2, chosen[1] / 2, chosen[2]), "number": (chosen[0], chosen[1], 0.0)}


# --- the operator ------------------------------------------------------------------------------------------------------------


def lexicon_of(rows: Iterable[tuple[str | None, str | None]]) -> dict[str, str]:
    """Names in small letters with their parts, of (name, name_part) rows."""
    parts: dict[str, set[str]] = defaultdict(set)
    for name, part in rows:
        if name:
            parts[name.lower()].add((part or "g")[0])
    return {n: "".join(sorted(p)) for n, p in parts.items()}


class Redactor:
    """Items of bodies, and bodies with placeholders in their place."""

    def __init__(self, lexicon: dict[str, str], model: tuple, placeholders: dict[str, str]):
        self.field, self.placeholders = Field(*model, lexicon), placeholders

    def items(self, body: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the items, in places of the body as it stands."""
        t = Text(body)
        return [(kind, t.place(a), t.place(b)) for kind, a, b in self.field.items(t.text)]

    def redact(self, body: str) -> str:
        out, at = [], 0
        for kind, start, end in self.items(body):
            if start >= at:
                begin = start
                while begin > at and body[begin - 1] in "+(" and kind == "phone":
                    begin -= 1
                out += [body[at:begin], self.placeholders.get(kind, f"[{kind.upper()}]")]
                at = end
        return "".join([*out, body[at:]])


def personal_items(df: DataFrame, key: str, text: str, encoding: str, mimetype: str, lexicon: DataFrame, kinds: DataFrame, redacted: str | None = None) -> DataFrame:
    """(key, kind, start_pos) of the items in responses' bodies, or (key, redacted) of every response.

    ``lexicon`` (name, name_part) and ``kinds`` (kind, placeholder) are small fixed tables; they and the weights go to the tasks as
    constants.  Null, empty and blank bodies have no items.  Images and fonts have none either and stay as they are.  Repeated rows
    are read row by row; a lexicon without rows leaves letters, shape and context to decide.
    """
    names = lexicon_of((r[0], r[1]) for r in lexicon.select("name", "name_part").distinct().collect())
    places = {r[0]: r[1] for r in kinds.select("kind", "placeholder").collect()}
    model = trained()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Redactor(names, model, places)
        for batch in batches:
            rows = []
            for k, t, e, m, media in batch.itertuples(index=False, name=None):
                body = decode_body(t, e, m)
                if redacted:
                    rows.append((k, body if media else tool.redact(body)))
                elif body:
                    rows.extend((k, kind, start) for kind, start, _ in tool.items(body))
            yield pd.DataFrame(rows, columns=[key, redacted] if redacted else [key, "kind", "start_pos"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, encoding, mimetype, is_media(F.col(mimetype)).alias("_media"))
    if not redacted:
        rows = rows.filter((F.col(text) != "") & ~F.col("_media"))
    return rows.mapInPandas(run, f"`{key}` {kind}, " + (f"`{redacted}` string" if redacted else "kind string, start_pos int"))


if __name__ == "__main__":
    save()
