"""String expressions shared by several operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(value: Column) -> Column:
    """Outer white space (no-break and zero-width included) off, inner runs to one blank."""
    return F.trim(F.regexp_replace(value, r"[\s\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+", " "))


def canonical_name(value: Column) -> Column:
    """One spelling of an identifier-like name: trimmed, lower case, ``_`` and blanks as ``-``."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), r"[_\s]+", "-"), F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


# An object from end to end, and what only lenient readers pass over inside one.
JSON_OBJECT, JSON_FLAW = r'(?s)^\{\s*".*\}$', r",\s*[}\]]|\}\s*\{"


def strict_json(value: Column) -> Column:
    """The text where it is one well-formed JSON object, else null; field readers alone would also read broken JSON."""
    return F.when(value.rlike(JSON_OBJECT) & ~value.rlike(JSON_FLAW) & F.try_parse_json(value).isNotNull(), value)
