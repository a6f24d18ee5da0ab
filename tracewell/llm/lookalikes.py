"""One consistent form for text that reads the same but has other characters (problem 8).

The form is a confusables skeleton: decompose, replace every character by the prototype of its look-alikes, decompose again.
Texts read the same exactly if their skeletons are equal.

The table of prototypes is made by rule from the Unicode data of Python: compatibility forms that differ in width, font or
joining only, white space, invisible characters; and from the list of letters below that look like a Latin one.  Superscripts,
fractions, circled signs, letter case, accents and digits stay what they are, as a reader sees the difference.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.io import once
from tracewell.operators.dedupe import spread_join

#: A Latin letter, and letters of other alphabets that look like it (Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu,
#: Deseret, rare Latin ones).
LETTERS = {
    "A": "ΑАᎪⲀꓮ", "B": "ΒВᏴⲂꓐ", "C": "ϹСᏟⲤꓚ𐐕", "D": "Ꭰꓓ", "E": "ΕЕᎬⲈꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНҺᎻⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ͿЈᎫꓙ", "K": "ΚКᏦⲔꓗ", "L": "ᏞꓡⳐ", "M": "ΜϺМᎷⲘꓟ",
    "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ𐐄", "P": "ΡРᏢⲢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՍᏚꓢ", "T": "ΤТᎢⲦꓔ", "U": "ꓴ", "V": "ᏙꓦѴ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥУҮⲨꓬ", "Z": "ΖᏃⲌꓜ",
    "a": "αаɑ", "c": "ϲс𐐽", "d": "ԁ", "e": "е", "g": "ցɡ", "h": "һհ", "i": "ιіɩı", "j": "јϳյ", "l": "ӏ", "n": "ո", "o": "οоօ𐐬", "p": "ρр", "q": "ԛզ", "r": "ґ", "s": "ѕՏ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "γу",
}
#: Letters whose small form is the capital made small: of alphabets whose small letters are such, these look like Latin ones.
SAME_SHAPE = "COSVWXZ"
#: A sign, and signs that look like it.
SIGNS = {"-": "\u2010\u2011\u2212", ".": "\u2024\ua4f8", "/": "\u2044\u2215", "'": "\u02b9\u055d\ua78c", "\u2019": "\u02bc", "\u2018": "\u02bb", ":": "\u05c3\u0589\u02d0\u2236\ua789", ";": "\uff1b\u037e", ",": "\u201a"}
#: Compatibility forms that a reader takes for the plain character.
SAME = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Characters without a shape, besides those of category Cf.
EMPTY = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
JOINERS = "‌‍"


def look_alikes() -> dict[str, str]:
    """Letter or sign to prototype, of the lists above and the rule for small letters."""
    out: dict[str, str] = {}
    for table in (LETTERS, SIGNS):
        for prototype, others in table.items():
            for ch in others:
                if ch in out or ch == prototype or (prototype.isalpha() and ch.isascii()):
                    raise ValueError(f"{ch!r} of {prototype!r} stands twice or for itself")
                out[ch] = prototype
    for ch, prototype in list(out.items()):
        small = ch.lower()
        if prototype in SAME_SHAPE and small != ch and small not in out and unicodedata.name(ch).split()[0] in ("CHEROKEE", "COPTIC", "DESERET"):
            out[small] = prototype.lower()
    for letter in SAME_SHAPE:  # small capitals of Latin
        name = f"LATIN LETTER SMALL CAPITAL {letter}"
        try:
            out.setdefault(unicodedata.lookup(name), letter.lower())
        except KeyError:
            continue
    return out


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Code point to prototype, for the characters that have one other than themselves."""
    out: dict[int, str] = {}
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            out[code] = " "
        elif kind in ("Zl", "Zp") or code == 0x85:
            out[code] = "\n"
        elif (kind == "Cf" and ch not in JOINERS) or code in EMPTY:
            out[code] = ""
        else:
            plain = _plain(ch)
            if plain != ch:
                out[code] = plain
    for ch, to in look_alikes().items():
        out[ord(ch)] = to
    # Prototypes of what compatibility forms come to (a math letter of Greek, a wide sign).
    return {c: "".join(out.get(ord(x), x) if out.get(ord(x), x) != chr(c) else x for x in to) for c, to in out.items()}


def _plain(ch: str) -> str:
    given = unicodedata.decomposition(ch)
    if not given.startswith("<") or given.split()[0] not in SAME:
        return ch
    to = "".join(chr(int(x, 16)) for x in given.split()[1:])
    if unicodedata.category(to[0])[0] == "Z":  # spacing accents
        return ch
    return unicodedata.normalize("NFD", "".join(_plain(x) for x in to))


#: A joiner counts where it shapes what is seen: between picture signs (with their modifiers), after a virama, in Arabic words.
_JOINER = re.compile("[‌‍]+")
_PICTURE = re.compile("[©®℀-➿⬀-⯿\U0001f000-\U0001faff️\U000e0020-\U000e007f]")


def _keeps(before: str, after: str, joiner: str) -> bool:
    if not before or not after:
        return False
    if joiner == "‍" and _PICTURE.match(before) and _PICTURE.match(after):
        return True
    if unicodedata.combining(before) == 9:
        return True
    return joiner == "‌" and "؀" <= before <= "ۿ" and "؀" <= after <= "ۿ"


def _joiners(text: str) -> str:
    def one(m: re.Match) -> str:
        a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        return m[0][0] if _keeps(a, b, m[0][0]) else ""

    return _JOINER.sub(one, text)


def skeleton(text: str | None) -> str | None:
    """The consistent form.  Null stays null, empty stays empty; line ends are ``\\n`` whatever they were."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    if "‍" in text or "‌" in text:
        text = _joiners(text)
    table = prototypes()
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def normalise(df: DataFrame, key: str, text: str, form: str = "skeleton") -> DataFrame:
    """(key, form): the consistent form of every row's text, for null texts null.  Other columns of ``df`` aren't read."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], form: pd.Series([skeleton(t) for t in batch[text]], dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, {form} string")


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, t): digests of 128 bits of skeleton and text, of rows with a skeleton that isn't empty."""
    import hashlib

    digest = lambda x: hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=16).digest()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, digest(s), digest(t)) for k, t in zip(batch[key], batch[text]) if t and (s := skeleton(t))]
            yield pd.DataFrame(rows, columns=[key, "s", "t"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, s binary, t binary")


def _cases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, t) of the rows whose skeleton has several texts."""
    rows = once(_keys(df, key, text))  # texts are read one time
    several = rows.groupBy("s").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select("s")
    return spread_join(rows, ["s"], several.withColumn("_of", F.lit(1)), [key]).filter("_of is not null").drop("_of")


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, n_texts, n_links) of the rows that some other text reads like: the class's least key, its different texts, and the rows
    of other texts in it.  Null and empty texts are in no class.  A class that a third of all rows are in is spread over tasks."""
    cases = _cases(df, key, text)
    texts = cases.groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    classes = texts.groupBy("s").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("_rows"))
    known = texts.join(classes, "s").select("s", "t", "class_id", "n_texts", (F.col("_rows") - F.col("n")).alias("n_links"))
    return spread_join(cases, ["s", "t"], known, [key]).select(key, "class_id", "n_texts", "n_links")


#: Rows of one text that meet their partners in one task, about.
PER_TASK = 100_000


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), a before b: rows whose texts differ but have one skeleton.  Null and empty texts are in no pair.

    Only digests are shuffled.  A first grouping, combined before its shuffle, finds the skeletons that have several texts.  Pairs
    are made between these distinct texts, and only then spread over the rows that hold them: copies of one text never meet each
    other, and no step has more rows than the result.  A text that very many rows hold is cut into parts by its rows' keys, so its
    pairs are made by many tasks.
    """
    cases = _cases(df, key, text)
    texts = cases.groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")).select("s", "t", F.ceil(F.col("n") / PER_TASK).cast("int").alias("parts"))
    rows = spread_join(cases, ["s", "t"], texts, [key]).select(F.col(key).alias("_k"), "t", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"))
    other = texts.select("s", F.col("t").alias("u"), F.col("parts").alias("u_parts"))
    pairs = texts.join(other, "s").filter("t < u")
    part = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    met = pairs.select("t", "u", "u_parts", part("parts").alias("part")).join(rows, ["t", "part"]).select(F.col("_k").alias("_a"), F.col("u").alias("t"), part("u_parts").alias("part"))
    ids = met.join(rows.withColumnRenamed("_k", "_b"), ["t", "part"]).filter("_a <> _b")  # rows that share a key, or have none, are no pair
    return ids.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"))
