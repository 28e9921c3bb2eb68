"""Column expressions of the cleaning rules: Column in, Column out, no jobs and no Python workers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as numbers.
NUMBER_WORDS = {
    "zero": 0.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0,
    "ten": 10.0, "twenty": 20.0, "thirty": 30.0, "forty": 40.0, "fifty": 50.0, "sixty": 60.0, "seventy": 70.0, "eighty": 80.0,
    "ninety": 90.0, "hundred": 100.0,
}
# Texts that stand for a missing value.
SENTINELS = ("unknown", "nan", "none", "null", "n/a", "na", "-", "$-", "", "invalid_date", "undefined", "#n/a")
# Texts of truth values.
TRUE_WORDS = ("yes", "true", "y", "1")
FALSE_WORDS = ("no", "false", "n", "0")
_DAY, _YEAR, _CLOCK = r"\d{1,2}", r"[+-]?\d{4,}", r"\d{2}:\d{2}:\d{2}"
_DATED, _WORD = r"\d{4}", rf"^[^\d\s]+ {_DAY},? {_YEAR}$"
#: Date formats that are read, and what a text must look like to be tried; single letters take one digit or two, brackets may be missing.
DATE_FORMATS = {
    "yyyy-M-d[ HH:mm:ss[.SSSSSS]]['T'HH:mm:ss]": rf"^{_YEAR}-{_DAY}-{_DAY}( {_CLOCK}(\.\d+)?|T{_CLOCK})?$",
    "yyyy/M/d": rf"^{_YEAR}/{_DAY}/{_DAY}$", "M/d/yyyy": rf"^{_DAY}/{_DAY}/{_YEAR}$", "MMMM d[,] yyyy": _WORD, "MMM d[,] yyyy": _WORD,
}
FIRST_DATE = "1900-01-01 00:00:00"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def blank_trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key(c: Column) -> Column:
    """Lower case and trimmed, the form that look-ups compare."""
    return blank_trimmed(F.lower(c.cast("string")))


def snake(c: Column) -> Column:
    return F.regexp_replace(key(c), r"(?U)\s+", "_")


def snake_name(name: str) -> str:
    return "_".join(name.strip().lower().split())


def plain_number(c: Column) -> Column:
    """The double that a text of digits writes, else null: no suffixes, no inf or nan."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def money(c: Column) -> Column:
    """A number once currency signs and blanks are gone and every comma is a point."""
    return plain_number(F.replace(F.regexp_replace(c, r"(?U)[$€£\s]", ""), F.lit(","), F.lit(".")))


def number_word(c: Column) -> Column:
    pairs = [F.lit(x) for pair in NUMBER_WORDS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key(c))


def number(c: Column) -> Column:
    return F.coalesce(number_word(c), money(c))


def scrubbed_number(c: Column) -> Column:
    """A number after everything but digits, points and minus signs is gone; commas are points."""
    kept = F.regexp_replace(F.replace(F.regexp_replace(c, r"(?U)[$€£\s]", ""), F.lit(","), F.lit(".")), r"[^\d.\-]", "")
    return plain_number(kept)


def any_date(c: Column) -> Column:
    """The first of DATE_FORMATS that reads the text; only texts of a format's shape are parsed."""
    text = blank_trimmed(c)
    tried = (F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in DATE_FORMATS.items())
    return F.when(text.rlike(_DATED), F.coalesce(*tried)).cast("timestamp_ntz")


def within(t: Column, now: Column) -> Column:
    """Null outside 1900 to now."""
    # an array of one, so that a costly time is computed once and not for each comparison
    return F.try_element_at(F.filter(F.array(t), lambda x: x.between(F.lit(FIRST_DATE).cast("timestamp_ntz"), now)), F.lit(1))


def date_cell(c: Column, now: Column) -> Column:
    """A date, unless the text is all digits but for points and commas."""
    return F.when(~F.regexp_replace(c, "[.,]", "").rlike(r"^\d+$"), within(any_date(c), now))


def looks_numeric(c: Column) -> Column:
    """All digits once the first point and leading minus signs are gone."""
    return F.regexp_replace(F.regexp_replace(c, r"^([^.]*)\.", "$1"), "^-+", "").rlike(r"^\d+$")


def truth(c: Column) -> Column:
    """Words of falsehood and the empty text are false, all else is true; null is null."""
    k = key(c)
    return F.when(k.isNull(), None).otherwise(~(k.isin(*FALSE_WORDS) | (k == "")))


def float_text(c: Column) -> Column:
    """A double as Python prints it, for magnitudes from 1e-4 to 1e16."""
    size = F.abs(c)
    whole = F.concat(c.try_cast("decimal(20,0)").cast("string"), F.lit(".0"))
    part = F.regexp_replace(c.try_cast("decimal(38,17)").cast("string"), "0+$", "")
    return F.when((size >= 1e16) | ((size < 1e-4) & (size > 0)), c.cast("string")).when(c == F.floor(c), whole).otherwise(part)


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@cache
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose decomposition has one ASCII character, these, and a few that have more."""
    one, to, more = [], [], []
    for point in range(0x80, 0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        folded = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one.append(chr(point))
            to.append(folded)
        elif folded and (point < 0x250 or 0xFB00 <= point < 0xFB07):
            more.append((chr(point), folded))
    return "".join(one), "".join(to), more


def _ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    """Runs of successive numbers: a pattern of few ranges is matched sooner than one of many characters."""
    out: list[tuple[int, int]] = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def fold_ascii(c: Column) -> Column:
    """Without accents and other non-ASCII characters; see ``fold_ascii_any`` for rare compatibility forms.

    Text in ASCII passes as it is, and characters that have more than one letter are looked
    for only where there is any.
    """
    one, to, more = _folds()
    letters = F.create_map(*(F.lit(x) for pair in more for x in pair))
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(letters, x), x)), "")
    rare = "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in _ranges(ord(x) for x, _ in more)) + "]"
    folded = F.regexp_replace(F.translate(F.when(c.rlike(rare), spread).otherwise(c), one, to), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


@F.pandas_udf(T.StringType())
def fold_ascii_any(s: pd.Series) -> pd.Series:
    """Fold by full Unicode decomposition, in Python workers."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def standard_text(c: Column, fold=fold_ascii) -> Column:
    """Folded, signs but hyphens to blanks, blanks single, trimmed, lower case; ``nan`` is null."""
    # signs and blanks in one pass, and nullif computes the text once
    return F.nullif(F.lower(F.trim(F.regexp_replace(fold(c), r"[^\w\-]+", " "))), F.lit("nan"))


def clipped(c: Column, low: Column, high: Column) -> Column:
    """Between low and high; null stays null, and null bounds don't bind."""
    return F.when(c.isNull(), None).otherwise(F.greatest(F.least(c, high), low))


def null_share(columns: list[str]) -> Column:
    """Share of the row's columns that are null."""
    return sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(max(1, len(columns))))
