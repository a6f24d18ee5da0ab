"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import SPACE, strip

#: Patterns in a dialect that Java and RE2 share.
FIND = r"(?:https?://|www\.)[^" + SPACE + r"\"'<>()\[\]{}]+"
TRAILING = r"[.,;:!?]+$"
ASCII_PREFIX = r"^[\x00-\x7F]+"
VALID = (
    r"^https?://(?:[^/?#@" + SPACE + r"]*@)?(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}|localhost"
    r"|(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?::[0-9]{1,5})?(?:[/?#][^" + SPACE + r"]*)?$"
)
AUTHORITY = r"^[^:/?#]+://([^/?#]*)"


def find_urls(c: Column) -> Column:
    """All URL texts of a message, in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(FIND), F.lit(0)), F.array().cast("array<string>"))


def clean_url(u: Column) -> Column:
    """A found URL cut at its first comma, without trailing marks, direction marks and what follows its ASCII part.

    The order matters: a dot before a direction mark stays.  Null where nothing is left or an asterisk occurs.
    """
    cut = F.substring_index(F.substring_index(u, ",", 1), "，", 1)
    bare = F.translate(F.regexp_replace(cut, TRAILING, ""), "‎‏", "")
    ascii_part = F.regexp_extract(bare, ASCII_PREFIX, 0)
    return F.when((ascii_part != "") & ~ascii_part.contains("*"), ascii_part)


def is_valid_url(u: Column) -> Column:
    """Whether a URL, with http:// put before it where it has no scheme, has a proper host, port and no white space."""
    full = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("http://"), u))
    return F.coalesce(full.rlike(VALID), F.lit(False))


def has_known_prefix(u: Column) -> Column:
    return u.startswith("http://") | u.startswith("https://") | u.startswith("www.")


def normalise_url(u: Column, mode: str = "default") -> Column:
    """Stripped, with http:// where no scheme is.  Mode ``legacy`` gives http:// for blank and no scheme to bare hosts."""
    s = strip(u)
    if mode == "legacy":
        return F.when(s == "", F.lit("http://")).otherwise(s)
    if mode != "default":
        raise ValueError(f"mode: {mode}")
    return F.when(s == "", F.lit("")).when(s.contains("://"), s).otherwise(F.concat(F.lit("http://"), s))


def authority(u: Column) -> Column:
    """The part between :// and the path as it is written; empty without a scheme."""
    return F.regexp_extract(u, AUTHORITY, 1)


def host(u: Column) -> Column:
    """Authority without user info and port, lower-cased; an IPv6 literal is cut at its first colon."""
    return F.lower(F.substring_index(F.substring_index(authority(u), "@", -1), ":", 1))


def registered_domain(u: Column) -> Column:
    """Last two labels of the host; numeric hosts, localhost and the empty host as they are; empty for null."""
    h = F.coalesce(host(u), F.lit(""))
    labels = F.split(h, r"\.")
    whole = (h == "") | (h == "localhost") | h.rlike(r"^[0-9.]+$") | (F.size(labels) < 2)
    return F.when(whole, h).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def netloc(u: Column) -> Column:
    """Lower-cased authority with port and user info, http:// put before where no scheme is; null for blank."""
    s = strip(u)
    return F.when(s != "", F.lower(authority(F.when(s.contains("://"), s).otherwise(F.concat(F.lit("http://"), s)))))


def final_url(u: Column) -> Column:
    """Without the query (a fragment before it stays)."""
    return F.substring_index(u, "?", 1)
