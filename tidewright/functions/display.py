"""What readers and logs show: short numbers, labels, ages, author lines, and texts that shouldn't be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How texts begin that describe a picture, and signs that end a sentence.
PICTURE_TEXTS = (r"^illustration\s+of\s+", r"^image\s+of\s+", r"^photo\s+of\s+", r"^screenshot\s+of\s+", r"^diagram\s+(of|showing)\s+", r"^figure\s+\d+", r"^a\s+(photo|image|illustration)\s+")
SENTENCE_ENDS = ("。", "！", "？", ".", "!", "?", "」")
# Keys of a record that must not be stored, and headers that must not be logged.
SENSITIVE_KEYS = ("authorization", "auth", "token", "api_key", "apikey", "secret", "password", "cookie", "session")
MARK = "[REDACTED]"


def short_number(value: Column) -> Column:
    """1234 as 1.2K, 5600000 as 5.6M; smaller ones as they are."""
    tenth = lambda per: F.format_string("%.1f", F.round(value / F.lit(float(per)), 1))
    return F.when(value >= 1_000_000, F.concat(tenth(1_000_000), F.lit("M"))).when(value >= 1_000, F.concat(tenth(1_000), F.lit("K"))).otherwise(value.cast("string"))


def tag_label(tag: Column) -> Column:
    """``text-generation`` as ``Text Generation``; letters after the first of each part stay."""
    parts = F.transform(F.split(tag, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(parts, " ")


def age_label(when: Column, now: Column) -> Column:
    """``5m ago``, ``3h ago``, ``Yesterday``, ``4d ago``, ``2w ago``; older ones by date, missing ones empty."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(when)) / F.lit(60_000_000))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return (
        F.when(when.isNull(), "").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days == 1, "Yesterday")
        .when(days < 7, ago(days, "d")).when(days < 30, ago(F.floor(days / 7), "w")).otherwise(F.date_format(when, "yyyy-MM-dd"))
    )


def author_line(authors: Column, shown: int = 3) -> Column:
    """The first authors, then how many more there are; null without authors."""
    first = F.array_join(F.slice(authors, 1, shown), ", ")
    more = F.size(authors) - shown
    return F.when(F.size(authors) > shown, F.concat(first, F.lit(" +"), more.cast("string"), F.lit(" more"))).when(F.size(authors) > 0, first)


def describes_picture(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("(?i)" + "|".join(PICTURE_TEXTS)), F.lit(False))


def lacks_end(text: Column) -> Column:
    """Whether a text that isn't empty ends without the end of a sentence."""
    last = F.right(F.rtrim(text), F.lit(1))
    return F.coalesce((text != "") & ~last.isin(*SENTENCE_ENDS), F.lit(False))


def clean_record(record: Column, keys: tuple[str, ...] = SENSITIVE_KEYS) -> Column:
    """A map without its sensitive keys (without case)."""
    return F.map_filter(record, lambda k, v: ~F.lower(k).isin(*keys))


def without_credentials(url: Column) -> Column:
    """User and password of an address replaced."""
    return F.regexp_replace(url, r"(https?://)([^:]+):([^@]+)@", rf"$1{MARK}:{MARK}@")


def backoff_ms(attempt: Column, base: int = 1000, factor: float = 2.0, most: int = 30_000) -> Column:
    """The wait before the next attempt (counted from 0), without its random part."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(factor), attempt), F.lit(float(most))).cast("bigint")
