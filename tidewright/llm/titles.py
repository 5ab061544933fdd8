"""Title hygiene shared by survivorship and entity matching: placeholder, damage, filler and additions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand where a title is missing.
PLACEHOLDERS = r"(?i)^\W*(untitled(\s+from\s.*)?|no title|title|n/?a|none|null|nil|tbd|todo|unknown|see (page|title)|(paper|item|post|story|article|record|entry|document|release|model)\s+#?[0-9a-f]{6,})?\W*$"
# What feeds put before a title.
PREFIX = r"(?i)^\s*(\[[^\]]{1,14}\]|\((pdf|paper|video|html)\)|(read|updated?|new|watch|paper|video|blog|post|release|model|weekly pick|pick)\s*(:|\s[–—-])|(weekly pick)\s*[–—:-])\s*"
#: A trailing part set off by a separator: the name of a site or feed.
SUFFIX = r"\s+[|·»–—-]\s+[^|·»:]{1,32}$"
MARKUP = r"</?[A-Za-z][^<>]*>"
ENTITY = r"&(#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);"
#: UTF-8 read as a one-byte encoding, or what replaces undecodable bytes.
MISDECODED = r"[ÂÃ][\x{80}-\x{BF}]|â€|\x{FFFD}"
CUT_MARK = r"(\.\.\.|…)\s*$"


def core(title: Column) -> Column:
    """The title without markup, entities, prefix, site name and cut mark."""
    text = F.regexp_replace(F.regexp_replace(title, MARKUP, ""), ENTITY, " ")
    text = F.regexp_replace(F.regexp_replace(text, PREFIX, ""), SUFFIX, "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, CUT_MARK, ""), r"\s+", " "))


def usable(title: Column) -> Column:
    return title.isNotNull() & ~title.rlike(PLACEHOLDERS)


def whole(title: Column) -> Column:
    """Whether nothing was found wrong with the title itself (a cut without a mark can't be seen here)."""
    found = "|".join((MARKUP, ENTITY, MISDECODED, CUT_MARK, PREFIX.replace("(?i)", ""), SUFFIX, r"^\s|\s$"))
    return usable(title) & ~title.rlike("(?i)" + found)
