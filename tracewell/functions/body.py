"""Bodies of captured responses: base64 and charset handling of one value, and its Arrow batch form."""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHARSET = re.compile(r";\s*charset\s*=\s*[\"']?\s*([^\"';\s]+)", re.I)


def charset_of(mimetype: str | None) -> str | None:
    """Charset that a content type names, without quotes; None if it names none."""
    found = _CHARSET.search(mimetype or "")
    return found[1] if found else None


def decode_body(text: str | None, encoding: str | None, mimetype: str | None) -> str:
    """Body of one response.

    Null gives the empty string.  Base64 (named in any letter case) gives its bytes read with the named charset, UTF-8 if
    none or an unknown one is named, bad bytes replaced.  Base64 that can't be decoded stays as it is.
    """
    if text is None:
        return ""
    if encoding is None or encoding.strip().lower() != "base64":
        return text
    try:
        raw = base64.b64decode(text)
    except ValueError:
        return text
    name = charset_of(mimetype) or "utf-8"
    try:
        if not codecs.lookup(name)._is_text_encoding:
            name = "utf-8"
    except LookupError:
        name = "utf-8"
    body = raw.decode(name, "replace")
    # Lone surrogates (utf-16 payloads cut in the middle, utf-7 ...) have no UTF-8 form.
    return body if body.isascii() else body.encode("utf-8", "replace").decode("utf-8")


@F.pandas_udf(T.StringType())
def _body_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, encoding, mimetype in batches:
        yield pd.Series([decode_body(*x) for x in zip(text, encoding, mimetype)], dtype=object)


def is_base64(encoding: Column) -> Column:
    return F.lower(F.trim(F.coalesce(encoding, F.lit("")))) == "base64"


def body(text: Column, encoding: Column, mimetype: Column) -> Column:
    """Body column.  Python sees only base64 rows' text: for all others it is the JVM's own column."""
    coded = is_base64(encoding)
    return F.when(coded, _body_udf(F.when(coded, text), F.when(coded, encoding), F.when(coded, mimetype))).otherwise(
        F.coalesce(text, F.lit(""))
    )
