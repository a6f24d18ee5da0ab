"""Text expressions.  Nulls give null unless a function says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode text sees it, for regular expressions of both Java and RE2, and as its characters.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Without white space at both ends, any Unicode white space."""
    return F.btrim(c, F.lit(SPACES))  # a pattern would try each run of white space inside the text as its end


def lstrip(c: Column) -> Column:
    """Without white space at its beginning."""
    return F.ltrim(c, F.lit(SPACES))


def nonblank(c: Column) -> Column:
    """Whether a value has a character other than white space; never null."""
    return F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))


def blank(c: Column) -> Column:
    """Whether a value is null, empty or white space only; never null."""
    return ~nonblank(c)


def has_alpha(c: Column) -> Column:
    """Whether any letter of any script occurs; false for null."""
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def truncate(c: Column, most: int = 25_000) -> Column:
    """At most ``most`` characters of the stripped text."""
    return F.left(strip(c), F.lit(most))


def preview(c: Column, most: int = 160) -> Column:
    """The text, cut to ``most`` characters and three dots where longer."""
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of fixed chunks over ``n`` characters: none for 0, one up to ``size``, then steps of size - overlap."""
    many = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)).cast("int"), F.lit(size - overlap))
    return F.when(n > 0, F.when(n <= size, F.array(F.lit(0))).otherwise(many)).otherwise(F.array().cast("array<int>"))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, though ``f`` names it often and inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dedupe_words(c: Column) -> Column:
    """Words in order, each once whatever its case, in its first spelling, joined by a space.

    Words are sorted to find first occurrences, so long texts cost no quadratic scan.
    """
    words = F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(F.lower(w).alias("k"), i.alias("i"), w.alias("w"))))
    firsts = bind(pairs, lambda o: F.filter(o, lambda p, i: (i == 0) | (p["k"] != F.get(o, i - 1)["k"])))
    by_place = F.array_sort(F.transform(firsts, lambda p: F.struct(p["i"].alias("i"), p["w"].alias("w"))))
    return F.array_join(F.transform(by_place, lambda p: p["w"]), " ")


#: Blocks whose presence makes up a script signature: fixed values.
SCRIPTS = (
    ("cjk", r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"),
    ("latin", r"[A-Za-z]"),
    ("arabic", r"[\x{0600}-\x{06FF}]"),
    ("cyril", r"[\x{0400}-\x{04FF}]"),
    ("thai", r"[\x{0E00}-\x{0E7F}]"),
    ("greek", r"[\x{0370}-\x{03FF}]"),
)


def scripts(c: Column) -> Column:
    """Names of the scripts that occur in a text, in the order of SCRIPTS; empty for null."""
    return F.array_compact(F.array(*(F.when(c.rlike(r), F.lit(name)) for name, r in SCRIPTS)))


def utility(score: Column, text: Column) -> Column:
    """Mean score times ln(1 + length)."""
    return score * F.log1p(F.char_length(text))


def words(c: Column) -> Column:
    """Distinct words of a normalised label."""
    return F.array_distinct(F.filter(F.split(c, " +"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two word sets, 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition.  ASCII values never leave the JVM as text."""
    plain = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain | c.isNull(), c).otherwise(_nfkc(F.when(~plain, c)))
