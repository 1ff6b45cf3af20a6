"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed: Unicode's, and the byte order mark.
SPACE = "[\\s\\x0b\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trim_all(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def summary_items(summary: Column) -> Column:
    """Parts of a summary between slashes, trimmed, without empty ones; an empty array for null."""
    return F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), "/"), trim_all), lambda x: x != "")


def parse_selection(text: Column) -> Column:
    """A comma list, each item URL-decoded (a plus stays a plus), trimmed, without empty ones; undecodable items are dropped."""
    decode = lambda x: trim_all(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), decode), lambda x: x != "")


def format_phone(text: Column) -> Column:
    """Digits as 3-4-4; shorter numbers as far as they go."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    three, four, rest = F.substring(digits, 1, 3), F.substring(digits, 4, 4), F.substring(digits, 8, 4)
    return F.when(F.length(digits) <= 3, digits).when(F.length(digits) <= 7, F.concat_ws("-", three, four)).otherwise(F.concat_ws("-", three, four, rest))


def last_word(text: Column) -> Column:
    return F.element_at(F.split(text, " "), -1)


def drop_suffix_once(text: Column, suffix: str = "카드") -> Column:
    """Without the first occurrence of ``suffix``."""
    return F.regexp_replace(text, f"^(.*?){suffix}", "$1")


def contains_folded(text: Column, part: Column) -> Column:
    """Case-insensitive substring test; false for null."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))
