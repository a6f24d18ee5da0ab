"""Text garbled by a wrong character encoding: found, and given back its characters (problem 1).

Garbled sequences are worked out beforehand for all pairs of a true and a wrong encoding, and one multi-pattern automaton finds
them.  Only matched spans are replaced; correct text around them stays.

* UTF-8 read with a single-byte encoding leaves two to four characters that stand for one: each such sequence of the repertoire
  is a pattern of the automaton.  Sequences that correct text can hold as well count only with support around them.  Letters
  outside the repertoire (Hangul, rare Han, Georgian ...) are told by runs: two sequences or more that give letters of one script.
* A single-byte encoding read with another leaves one character for one, and multi-byte ones leave runs.  These are told from
  correct text by their place in a word, and the reading that was lost must be a plausible one.

A text is looked at word by word, where a word is a run of letters with at least one character, or escape of one, outside ASCII.
A worker keeps verdicts on words up to a bound, so frequent words are judged once; the result doesn't depend on that.
"""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.body import decode_body

#: Single-byte encodings in which UTF-8 may have been read.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman")
#: Encodings in which the bytes of a body that was read wrongly are tried.
LIKELY = ("utf-8", "cp1252", "cp1251", "cp1250", "koi8-r", "cp866", "gb18030", "shift_jis", "euc_jp", "big5")
#: Blocks of characters that are looked for as garbled: letters, signs, kana, full-width forms, pictures.
BLOCKS = (
    (0x80, 0x17F), (0x192, 0x192), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x218, 0x21B), (0x2C6, 0x2DD), (0x300, 0x30C), (0x386, 0x3CE), (0x400, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x94D),
    (0xE01, 0xE4E), (0x1EA0, 0x1EF9), (0x2010, 0x2027), (0x202F, 0x203A), (0x2044, 0x2044), (0x20A9, 0x20BF), (0x2103, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265), (0x2500, 0x25CF),
    (0x2600, 0x2606), (0x2705, 0x2716), (0x3000, 0x3011), (0x3041, 0x3093), (0x30A1, 0x30FC), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0xFFFD, 0xFFFD), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF))
#: Lead bytes of the first, frequent level of two double-byte sets.
COMMON = (("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF))
#: Kept verdicts of a worker, and the longest word kept.
KEPT, KEPT_LENGTH = 300_000, 80


def common_han() -> set[str]:
    out = set()
    for name, low, high in COMMON:
        for a in range(low, high + 1):
            for b in range(0xA1, 0xFF):
                try:
                    out.add(bytes((a, b)).decode(name))
                except UnicodeDecodeError:
                    pass
    return out


def _sloppy(raw: bytes, name: str) -> str:
    """Bytes read in a single-byte encoding; those it doesn't have read as Latin-1, as browsers do."""
    return "".join(bytes((b,)).decode(name, "ignore") or chr(b) for b in raw)


@lru_cache(maxsize=None)
def _sequences(name: str) -> tuple[re.Pattern, dict[str, int]]:
    """Runs of two or more UTF-8 sequences of two or three bytes as an encoding shows them, and its characters' bytes."""
    back: dict[str, int] = {}
    for b in range(0x80, 0x100):
        back.setdefault(_sloppy(bytes((b,)), name), b)
    some = lambda low, high: "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"
    trail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{trail}|{some(0xE0, 0xEF)}{trail}{trail}){{2,}}"), back


def _script(text: str) -> str | None:
    """The script that all characters of a text are letters or marks of; None if they aren't of one."""
    scripts = {unicodedata.name(c, "").split(" ")[0] if unicodedata.category(c)[0] in "LM" else "" for c in text}
    return scripts.pop() if len(scripts) == 1 else None


_RUSSIAN = "А-Яа-яЁё"
#: What follows a Cyrillic capital in correct text too: small yo, closing signs, dashes, spaces.
_NATURAL = "ёЁ«»“”„‘’‚…–—•\xa0"
#: How a Russian word goes: e reversed, hard and soft signs, short i and the hard i stand in few places; three vowels don't meet.
_RUSSIAN_WORD = re.compile(r"(?!й(?!о)|ы|ь|ъ)(?:э(?=[а-яё])|(?<=[аеёиоуюя])[эй]|(?<=[бвгджзклмнпрстфхцчшщ])[ыь]|(?<=[бвгджзклмнпрстфх])ъ(?=[еёюя])|й(?=о)|[аеёиоуюябвгджзклмнпрстфхцчшщ]|(?<=[ыэ])й)+(?<![аеёиоуыэюя]{4})")
#: Letters that are listed as such in correct text.
_LETTER_LIST = set("äöüõåßæøÄÖÜÕÅÆØ")
_CYRILLIC_VOWELS = set("аеёиоуыэюяАЕЁИОУЫЭЮЯ")


def _weak(sequence: str) -> bool:
    """Whether correct text may hold a garbled sequence: one of two characters, or of letters of one script."""
    if all("А" <= c <= "я" for c in sequence):
        return True
    if len(sequence) != 2:
        return False
    a, b = sequence
    if "А" <= a <= "я":
        return b in _NATURAL or "А" <= b <= "я"
    if a in "–—":
        return True
    return a.isalpha() and a not in "ÂÃÄÅÐÑƒ" and (b in _NATURAL or b.isalpha())


_ESCAPED = r"(?:\\u[0-9a-fA-F]{4}|&#?\w{2,8};)"
#: A word with a character outside ASCII, or the escape of one.
WORD = re.compile(r"(?:(?<![A-Za-z\\])|(?<=\\[nrtbf]))[A-Za-z]*+(?:(?:[^\x00-\x7f]|\\u[0-9a-fA-F]{4}|&#?\w{2,8};)[A-Za-z]*+)++")
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_LONE = re.compile("[\ud800-\udfff]")


def unescape(word: str) -> str:
    """A word with its JSON escapes and character references read."""
    if "\\u" in word:
        word = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), word)
        word = _SURROGATES.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), word)
        word = _LONE.sub("", word)
    if "&" in word:
        # 128 to 159 stay control characters: garbling leaves them, and browsers' mending of them would hide it
        word = re.sub(r"&#(1[2-5]\d);", lambda m: chr(int(m[1])) if 128 <= int(m[1]) <= 159 else m[0], word)
        word = html.unescape(word)
    return word


_LOWER, _UPPER = "a-zà-öø-ÿ", "À-ÖØ-ÞŠŒŽŸ"
#: Signs that correct words don't have inside.
_SIGNS = "‰ˆ˜¸·‡†∞≤≥÷±¤¦§¨©ª«¬¯°²³¶¹º»¼½¾¿√∂∑∏∫≠≈◊⁄‹›˙˚˝⌡⌠■▀▄█░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌"
_ODD = (
    # a sign inside a word; at its end; a capital with an accent after a small letter
    re.compile(f"[a-z][{_SIGNS}][{_LOWER}]"),
    re.compile(f"[a-z]{{2}}[‰ˆ˜¸·‡∞≤≥÷¤¦¨¬¯¹¿√∂∑˙⌡├┬╝]+$"),
    re.compile(f"^[ˆ‰˜¸⌡÷≤≥±¤¦¹¿§]+(?=[a-z]{{3}})(?!¿)"),
    re.compile(f"[{_LOWER}][{_UPPER}]+(?:[{_LOWER}]|$)"),
    re.compile(f"^[A-Z][À-ÖØ-Þ][{_LOWER}]{{2}}"),
    re.compile("[∞][CF]$"),
    # dotless i next to a vowel, which Turkic words don't have; a Latin-1 letter for o with tilde beside it
    re.compile("[aeiouäöüAEIOU]ı|ı[aeiouäöü]"),
    # an apostrophe that became an accented i
    re.compile("^(?:[ldsjcmntLDSJCMNT]|[Qq]u)í[aeiouhéêè][a-zé]{4}"),
    re.compile("°⁄"),
    # Greek, Cyrillic or box letters next to small Latin ones
    re.compile("[a-z][\u0386-\u03ce\u0400-\u04ff]|[\u0386-\u03ce\u0400-\u04ff][a-z]{2}"),
    # small then capitals, or signs, in a Cyrillic word
    re.compile("[а-яё][А-ЯЁ]{2}|^[а-яё][А-ЯЁ]+$"),
    # lone signs of money
    re.compile("^[ЈЂ]$"),
    re.compile("[а-яёА-ЯЁҐЄЇЎўґєї][®©¤¬¦§°±¶·†‡‹›µ][а-яёА-ЯЁҐЄЇЎўґєї]"),
    re.compile("œ[wclmkpzń]"),
    # bytes of double-byte sets
    re.compile("ƒ[A-Za-z\\[\\]\x80-\xff‚„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸ]|‚[\xa0-\xff]"),
    re.compile("[a-z][\uff66-\uff9f]|[\uff66-\uff9f][a-z]"),
    re.compile("[a-z][\u4e00-\u9fff]{1,2}[a-z]{2}"),
)
_HIGH = re.compile("[\xa1-\xffŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™\x80-\x9f]{3,}")
_CJK = re.compile("[一-鿿㐀-䶿豈-﫿ｦ-ﾟ぀-ヿ㄀-ㄯ㈠-㉃＀-￯ -⁯-\xb7]{3,}")


def _bytes_of(text: str) -> bytes | None:
    out = bytearray()
    for ch in text:
        if ch < "Ā":
            out.append(ord(ch))
        else:
            try:
                out += ch.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


class Repairer:
    """The automaton, and verdicts on words."""

    def __init__(self, wrong: tuple[str, ...] = WRONG):
        self.han = common_han()
        chars = [chr(c) for a, b in BLOCKS for c in range(a, b + 1)] + sorted(self.han)
        self.wrong, self.chars = wrong, frozenset(chars)
        table: dict[str, tuple[str, int]] = {}
        for place, name in enumerate(wrong):
            for ch in chars:
                sequence = _sloppy(ch.encode("utf-8"), name)
                # of sequences with two readings the one of the earlier encoding holds
                if sequence not in table and not sequence.isascii() and len(sequence) > 1:
                    table[sequence] = (ch, place)
        self.automaton = ahocorasick.Automaton()
        for sequence, (ch, place) in table.items():
            self.automaton.add_word(sequence, (len(sequence), ch, place, _weak(sequence)))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[bool, str]] = {}

    def spans(self, word: str) -> list[tuple[int, int, str, bool]]:
        """Matches (start, end, character, weak) from left to right without overlap, the longest of each start."""
        best: dict[int, tuple[int, str, bool]] = {}
        for end, (size, ch, _, weak) in self.automaton.iter(word):
            start = end + 1 - size
            if start not in best or best[start][0] < end + 1:
                best[start] = (end + 1, ch, weak)
        out, at = [], 0
        for start in sorted(best):
            if start >= at:
                at = best[start][0]
                out.append((start, *best[start]))
        return out

    def _runs(self, word: str, spans: list[tuple[int, int, str, bool]]) -> str | None:
        """The word with its longest run of UTF-8 sequences of one script replaced that has letters without patterns; None if it has none."""
        best, reading = "", ""
        for name in self.wrong:
            pattern, back = _sequences(name)
            for m in pattern.finditer(word):
                run = m[0]
                # patterns that fit go first; letters of one alphabet in their natural cases are correct text
                if len(run) <= len(best) or 2 * sum(min(e, m.end()) - max(s, m.start()) for s, e, _, _ in spans if s < m.end() and m.start() < e) > len(run) or (run.isalpha() and _script(run) and not re.search("[а-яё][А-ЯЁ]", run)):
                    continue
                try:
                    text = bytes(back[c] for c in run).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if not self.chars.issuperset(text) and len(text) > 1 and _script(text) not in (None, "", "LATIN", "GREEK", "CYRILLIC", "COMBINING"):
                    best, reading = run, text
        return word.replace(best, reading) if best else None

    def _matched(self, word: str) -> str | None:
        """The word with matched spans replaced, if they are garbled; None if not."""
        spans = self.spans(word)
        if (text := self._runs(word, spans)) is not None:
            return text
        if not spans:
            return None
        strong = [s for s in spans if not s[3]]
        if not strong:
            beside = any((s > 0 and word[s - 1].isascii() and word[s - 1].isalpha()) or (e < len(word) and word[e].isascii() and word[e].isalpha()) for s, e, _, _ in spans)
            covered = sum(e - s for s, e, _, _ in spans)
            if not beside and not (len(spans) > 1 and covered >= 0.8 * len(word)):
                return None
            if all("А" <= c <= "я" for c in word) and not re.search("[а-я][А-Я]", word):
                return None
        if sum(e - s for s, e, _, _ in spans) < 0.6 * len(word) and (run := _HIGH.search(word)) and len(run[0]) >= 6 and (raw := _bytes_of(run[0])) and (text := self._double_byte(raw)):
            return word.replace(run[0], text)
        out, at = [], 0
        for s, e, ch, _ in spans:
            out += [word[at:s], ch]
            at = e
        return "".join([*out, word[at:]])

    def _russian(self, raw: bytes) -> str | None:
        for name in ("cp1251", "koi8-r", "cp866"):
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            if not _RUSSIAN_WORD.fullmatch(text.lower()) or not (text[1:].islower() or (text.isupper() and (name == "cp1251" or len(text) > 5))):
                continue
            letters = [c for c in text if "Ѐ" <= c <= "ӿ"]
            if len(letters) < len(text) or not _CYRILLIC_VOWELS & set(text) or re.search("[а-яё][А-ЯЁ]", text):
                continue
            if any(c not in _CYRILLIC_VOWELS for c in text) and 0.2 <= sum(c in _CYRILLIC_VOWELS for c in text) / len(text) <= 0.75:
                return text
        return None

    def _common(self, c: str) -> bool:
        return c in self.han or "ぁ" <= c <= "ヺ" or c in "ー、。，！：；？「」（）￥" or "가" <= c <= "힣"

    def _double_byte(self, raw: bytes) -> str | None:
        for name in ("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr"):
            for cut in (raw, raw[:-1], raw[1:]):
                try:
                    text = cut.decode(name)
                except UnicodeDecodeError:
                    continue
                if name == "gb18030" and any("ぁ" <= c <= "ヺ" for c in text):
                    continue  # kana stand in all these sets, but for Japanese text
                good = sum(map(self._common, text))
                if len(text) >= 2 and good >= 0.75 * len(text):
                    return text
        return None

    def _odd(self, word: str) -> str | None:
        """A word whose characters stand one for one, or in runs, for others: its likeliest reading; None if it is correct."""
        for m in _HIGH.finditer(word):
            run = m[0]
            near = word[max(0, m.start() - 1) : m.start()] + word[m.end() : m.end() + 1]
            raw = _bytes_of(run)
            if raw is None:
                continue
            if not (near.isascii() and near.isalpha()) and not set(run) <= _LETTER_LIST and (text := self._russian(raw)):
                return word.replace(run, text)
            if len(run) >= (8 if run.isalpha() else 4) and (text := self._double_byte(raw)):
                return word.replace(run, text)
        for m in _CJK.finditer(word):
            for name in ("gbk", "shift_jis", "big5", "euc_kr"):
                try:
                    raw = m[0].encode(name)
                except UnicodeEncodeError:
                    continue
                for back in range(4):
                    try:
                        text = raw[: len(raw) - back].decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if sum(c in self.han or "ぁ" <= c <= "ヿ" or c < "ӿ" or "　" <= c <= "】" or "！" <= c <= "～" for c in text) >= 0.8 * len(text):
                        return word.replace(m[0], text)
        if any(x.search(word) for x in _ODD):
            return self._one_for_one(word)
        return None

    @staticmethod
    def _one_for_one(word: str) -> str:
        """Read back by the pair of encodings that makes the word plain Latin, or Cyrillic, letters; as it is if none does."""
        plain = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿąćęłńóśźżĄĆĘŁŃŚŹŻœŒšŠžŽ¡¿’°£€–—“”…•]+")
        for wrong, true in (("cp1252", "cp1250"), ("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("iso8859-7", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman")):
            try:
                text = word.encode(wrong).decode(true)
            except UnicodeError:
                continue
            if plain.fullmatch(text) and not any(x.search(text) for x in _ODD):
                return text
        for wrong, true in (("cp1251", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251")):
            try:
                text = word.encode(wrong).decode(true)
            except UnicodeError:
                continue
            if re.fullmatch(f"[{_RUSSIAN}]+", text) and not re.search("[а-яё][А-ЯЁ]", text):
                return text
        return word

    def judge(self, word: str) -> tuple[bool, str]:
        """Whether a word (escapes read) is garbled, and its repaired form."""
        if (known := self.known.get(word)) is not None:
            return known
        text, garbled = word, False
        while (better := self._matched(text)) is not None and len(better) < len(text):  # garbled more than once; each reading is shorter
            text, garbled = better, True
        if not garbled and (better := self._odd(text)) is not None:
            text, garbled = better, True
        if "�" in word or re.search("[\x80-\x9f]", word):
            garbled = True
        if len(word) <= KEPT_LENGTH:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = (garbled, text)
        return garbled, text

    def is_garbled(self, body: str) -> bool:
        if body.isascii() and "\\u" not in body and "&" not in body:
            return False
        return any(self.judge(w if w.isprintable() and "\\" not in w and "&" not in w else unescape(w))[0] for w in WORD.findall(body))

    def repair(self, body: str) -> str:
        """The body with garbled words repaired; all else, escapes of correct words too, as it is."""

        def one(m: re.Match) -> str:
            garbled, text = self.judge(unescape(m[0]))
            return text if garbled else m[0]

        return WORD.sub(one, body)


    def reread(self, raw: bytes) -> str | None:
        """Bytes read with the first likely encoding that fits them all and leaves no garbled word; None if none does."""
        for name in LIKELY:
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                continue
            wide = [c for c in text if c > "\x7f"]
            if name in LIKELY[6:] and sum(self._common(c) for c in wide) < 0.75 * len(wide):
                continue
            if name == "gb18030" and any("ぁ" <= c <= "ヺ" for c in wide):
                continue  # kana stand in all these sets, but for Japanese text
            if not self.is_garbled(text):
                return text
        return None

    def mend(self, body: str, text: str | None, encoding: str | None) -> str:
        """A garbled response's body repaired: from its bytes if it was base64, as they lost nothing, else span by span."""
        if text is not None and encoding is not None and encoding.strip().lower() == "base64":
            try:
                if (whole := self.reread(base64.b64decode(text))) is not None:
                    return whole
            except ValueError:
                pass
        return self.repair(body)


@lru_cache(maxsize=1)
def repairer() -> Repairer:
    return Repairer()


def is_media(mimetype: Column) -> Column:
    """Whether a type is an image's or a font's."""
    kind = F.lower(F.trim(F.coalesce(mimetype, F.lit(""))))
    return kind.startswith("image/") | kind.startswith("font/") | kind.rlike("^application/(x-)?font")


def garbled_bodies(df: DataFrame, key: str, text: str, encoding: str, mimetype: str, repaired: str | None = None) -> DataFrame:
    """(key), or (key, repaired), of the responses whose body has garbled text.

    Images and fonts are left out.  Null and empty bodies are never garbled.  Base64 bodies are read again from their bytes where
    another encoding fits them whole; else matched spans are replaced, and what can't be repaired stays in the repaired body.
    Repeated rows are judged row by row; other columns of ``df`` aren't read.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = repairer()
        for batch in batches:
            keys, bodies = [], []
            for k, *response in batch.itertuples(index=False, name=None):
                body = decode_body(*response)
                if body and tool.is_garbled(body):
                    keys.append(k)
                    if repaired:
                        bodies.append(tool.mend(body, response[0], response[1]))
            yield pd.DataFrame({key: keys, repaired: bodies} if repaired else {key: keys})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, encoding, mimetype).filter((F.col(text) != "") & ~is_media(F.col(mimetype)))
    return rows.mapInPandas(run, f"`{key}` {kind}" + (f", `{repaired}` string" if repaired else ""))
