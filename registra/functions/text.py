"""Text expressions. Absence is null inside the library; "" appears only in finished reports."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "FULLWIDTH")


def _plain_letters() -> dict[str, str]:
    """Small letters that Unicode takes apart into plain ones and marks (or wider forms), and what is left of them."""
    out = {}
    for code in range(0x80, 0x10000):
        letter = chr(code)
        if letter.isalpha() and letter == letter.lower() and unicodedata.name(letter, "").startswith(SCRIPTS):
            parts = unicodedata.normalize("NFKD", letter).lower()
            plain = "".join(c for c in parts if not unicodedata.combining(c))
            if plain != letter and plain.isalpha():
                out[letter] = plain
    return out


_LETTERS = _plain_letters()
_SINGLE = {letter: plain for letter, plain in _LETTERS.items() if len(plain) == 1}
_LONGER = {letter: plain for letter, plain in _LETTERS.items() if len(plain) > 1}
# Text accepted as "true".
TRUE_WORDS = ("1", "true", "t", "yes", "y", "oui", "o")


def digits(value: Column) -> Column:
    """ASCII digits of a value; "" for null."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9]", "")


def text_or_null(value: Column) -> Column:
    """Trimmed text, null when blank or the literal word nan."""
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin("", "nan"), trimmed)


def first_text(values: Iterable[Column]) -> Column:
    return F.coalesce(*[text_or_null(v) for v in values])


def joined_text(values: Iterable[Column], separator: str = " ") -> Column:
    """Non-blank parts joined in order, null when there is none."""
    joined = F.concat_ws(separator, *[text_or_null(v) for v in values])
    return F.nullif(joined, F.lit(""))


def fold(value: Column) -> Column:
    """Trimmed lower-case text without accents, "" for null."""
    lowered = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\p{M}+", "")
    plain = F.translate(lowered, "".join(_SINGLE), "".join(_SINGLE.values()))
    longer = plain
    for letter, letters in _LONGER.items():
        longer = F.replace(longer, F.lit(letter), F.lit(letters))
    return F.when(plain.rlike(f"[{''.join(_LONGER)}]"), longer).otherwise(plain)


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def date_or_null(value: Column) -> Column:
    """Lenient date: text that is no date becomes null instead of failing the job."""
    return F.try_to_timestamp(F.trim(value))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Oui").otherwise("Non")


def search_link(base: str, value: Column) -> Column:
    """Percent-encoded link; url_encode writes a blank as +, links want %20."""
    return F.concat(F.lit(base), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")))
