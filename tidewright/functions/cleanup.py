"""Text clean-up: secrets, Markdown and LaTeX, sentence-aware shortening, dates and JSON in free text."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forms of secrets, in the order they are replaced.
SECRETS = (
    ("google_oauth_access", r"\bya29\.[a-zA-Z0-9_\-\.]+\b"), ("google_oauth_refresh", r"\b1//[a-zA-Z0-9_\-]+\b"),
    ("api_key_sk", r"\bsk-[a-zA-Z0-9]{20,}\b"), ("api_key_pk", r"\bpk-[a-zA-Z0-9]{20,}\b"), ("api_key_generic", r"\bkey-[a-zA-Z0-9]{20,}\b"),
    ("bearer_token", r"(?i)\bBearer\s+[a-zA-Z0-9_\-\.]+\b"), ("github_token", r"\bgh[pousr]_[a-zA-Z0-9]{36,}\b"), ("github_classic", r"\bghp_[a-zA-Z0-9]{36}\b"), ("hf_token", r"\bhf_[a-zA-Z0-9]{34,}\b"),
    ("password_value", r"(?i)\bpassword\s*[=:]\s*['\"]?[^\s'\"]{8,}['\"]?"), ("secret_value", r"(?i)\bsecret\s*[=:]\s*['\"]?[^\s'\"]{8,}['\"]?"),
    ("token_value", r"(?i)\btoken\s*[=:]\s*['\"]?[^\s'\"]{20,}['\"]?"), ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"), ("aws_secret_key", r"\b[a-zA-Z0-9/+=]{40}\b"),
    ("base64_long", r"\b[a-zA-Z0-9+/]{50,}={0,2}\b"), ("auth_header", r"(?i)Authorization:\s*[^\n]+"), ("cookie_header", r"(?i)Cookie:\s*[^\n]+"), ("set_cookie_header", r"(?i)Set-Cookie:\s*[^\n]+"),
)


def secrets_found(text: Column, patterns: tuple = SECRETS) -> Column:
    """Names of the forms that occur, in order. Words, blanks and case are those of Unicode, as in the reference."""
    hits = F.array(*[F.when(text.rlike("(?U)" + p), F.lit(name)) for name, p in patterns])
    return F.filter(hits, lambda h: h.isNotNull())


def redacted(text: Column, patterns: tuple = SECRETS, mark: str = "[REDACTED]") -> Column:
    for _, pattern in patterns:
        text = F.regexp_replace(text, "(?U)" + pattern, mark.replace("$", "\\$"))
    return text


def readme_summary(text: Column, lines: int = 10, shortest: int = 10, limit: int = 800) -> Column:
    """The first lines of prose of a README: no front matter, tags, images, badges, links or headers; cut at a word."""
    bare = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    bare = F.regexp_replace(bare, r"!\[[^\]]*\]\([^)]*\)", "")
    bare = F.regexp_replace(bare, r"\[([^\]]*)\]\([^)]*\)", "$1")
    bare = F.regexp_replace(bare, r"(?m)^#+\s*.*$", "")
    kept = F.filter(F.transform(F.split(bare, "\n"), lambda l: F.trim(l)), lambda l: F.length(l) >= shortest)
    joined = F.array_join(F.slice(kept, 1, lines), " ")
    cut = F.regexp_replace(F.substring(joined, 1, limit), r"\s+\S*$", "")
    return F.when(F.length(joined) <= limit, joined).otherwise(F.concat(cut, F.lit("...")))


def latex_decoded(text: Column) -> Column:
    """Reading form of LaTeX in titles: text and emphasis commands unwrapped, accents and common symbols resolved, signs dropped."""
    out = F.regexp_replace(text, r"\\(?:textbf|textit|textsc|texttt|emph|mathrm|mathbf|mathcal|text)\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\['`^\"~=.]\{?([A-Za-z])\}?", "$1")
    for name, sign in (("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("lambda", "λ"), ("times", "×"), ("infty", "∞"), ("to", "→"), ("leq", "≤"), ("geq", "≥")):
        out = F.regexp_replace(out, rf"\\{name}\b", sign)
    out = F.regexp_replace(F.regexp_replace(out, r"\$([^$]*)\$", "$1"), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sentence_cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters: cut after the last full sentence in the second half, else with an ellipsis."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
    return F.when(F.length(text) <= limit, text).when(F.length(sentence) * 2 > limit, sentence).otherwise(F.concat(F.trim(F.substring(text, 1, limit - 3)), F.lit("...")))


def normal_fulltext(text: Column) -> Column:
    """One kind of line end, no runs of blanks, at most one empty line."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def unfenced(text: Column) -> Column:
    """What a fenced block of a model's answer holds, else the answer."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


@F.pandas_udf(T.StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    """The first whole JSON object or array in a text as written; null where there is none. The decoder is tried
    at each opening bracket, so brackets of two kinds never balance each other."""
    decoder = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        for opening in re.finditer(r"[\[{]", text or ""):
            try:
                return text[opening.start() : decoder.raw_decode(text, opening.start())[1]]
            except (ValueError, RecursionError):
                continue
        return None

    return texts.map(first)


@F.pandas_udf(T.StringType())
def compatibility_form(texts: pd.Series) -> pd.Series:
    """Unicode NFKD, which Spark has no expression for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))
