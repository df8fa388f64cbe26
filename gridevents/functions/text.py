"""Text expressions for list files, keys and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shapes of the texts that are read.
STAMP_PATTERN = r"\d{4}-\d\d-\d\dT[0-9:.]+"
NUMBER_PATTERN = r"-?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
PAIR_PATTERN = rf"\(?\s*({NUMBER_PATTERN})\s*,\s*({NUMBER_PATTERN})\s*\)?"


def bare_name(name: Column) -> Column:
    """An algorithm name given as a path (``/name/``) without its slashes."""
    return F.regexp_replace(name, r"^/(.*)/$", "$1")


def pair_part(line: Column, part: int) -> Column:
    """First (1) or second (2) number of an ``(a, b)`` text."""
    return F.regexp_extract(line, PAIR_PATTERN, part).try_cast("double")


def stamps_in(line: Column) -> Column:
    """Array of every stamp that occurs in a line."""
    return F.regexp_extract_all(line, F.lit(STAMP_PATTERN), F.lit(0))


def inner_tokens(line: Column) -> Column:
    """Comma tokens of a bracketed line, without the first two and the last."""
    tokens = F.split(line, ",")
    return F.slice(tokens, F.lit(3), F.greatest(F.size(tokens) - 3, F.lit(0)))


def before_colon(token: Column) -> Column:
    """A quoted token without blanks and quotes, cut at its first colon."""
    return F.substring_index(F.regexp_replace(token, r"[\s'\"\[\]]", ""), ":", 1)


def comma_list(text: Column) -> Column:
    """Comma text as an array of trimmed items."""
    return F.transform(F.split(text, ","), lambda item: F.trim(item))


def bracket_list(items: Column) -> Column:
    """An array of texts as one bracketed, quoted list."""
    quoted = F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def place_key(lat: Column, lon: Column, time: Column) -> Column:
    """Key of an event: place and stamp in one text."""
    return F.concat(lat.cast("string"), lon.cast("string"), F.lit("_"), time)


def place_year_key(lat: Column, lon: Column, year: Column) -> Column:
    """Key of a place in one year."""
    return F.concat(lon.cast("string"), F.lit("E_"), lat.cast("string"), F.lit("N_"), year.cast("string"))


def first_digit(text: Column) -> Column:
    """First character as an integer."""
    return F.substring(text, 1, 1).try_cast("int")


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def category(code: Column, value: int, match: str, other: str) -> Column:
    """Category text of a label: ``match`` for ``value``, else ``other``."""
    return F.when(code == value, match).otherwise(other)
