"""Feeds, interface answers and pages as DataFrames of items.

Every reader takes a DataFrame of raw payloads (source_id, payload) as fetched or read from files, so that parsing
runs in parallel and apart from the network, and gives the item columns of ``ITEM``. Malformed payloads give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import url as U

ITEM = "source_id string, url string, title string, published_at timestamp, date_confidence string, kind string, raw_json string"
RFC = ("EEE, dd MMM yyyy HH:mm:ss zzz", "EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")


def read_time(text: Column) -> Column:
    """The first of the usual feed formats that fits, else null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, (\d) ", "Mon, 0$1 ")
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(bare, r"^[A-Za-z]{3}, ", ""), F.lit(f.replace("EEE, ", ""))) for f in RFC])


def _items(rows: DataFrame, published: Column, updated: Column, kind: str, raw: list[Column]) -> DataFrame:
    when = F.coalesce(read_time(published), read_time(updated))
    confidence = F.when(read_time(published).isNotNull(), "high").when(when.isNotNull(), "medium").otherwise("low")
    found = rows.select("source_id", "url", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), when.alias("published_at"), confidence.alias("date_confidence"), F.lit(kind).alias("kind"), F.to_json(F.struct(*raw)).alias("raw_json"))
    return found.where(U.is_web(F.col("url")) & (F.col("title") != ""))


def rss(payloads: DataFrame, kind: str = "blog") -> DataFrame:
    """RSS 2.0 channels."""
    schema = "channel struct<item array<struct<title string, link string, guid string, pubDate string, description string, author string, category array<string>>>>"
    rows = payloads.select("source_id", F.explode(F.from_xml("payload", schema).getField("channel").getField("item")).alias("i"))
    rows = rows.select("source_id", F.coalesce(F.nullif(F.trim("i.link"), F.lit("")), F.col("i.guid")).alias("url"), F.col("i.title").alias("title"), F.col("i.pubDate").alias("p"), "i")
    return _items(rows, F.col("p"), F.lit(None).cast("string"), kind, [F.col("url").alias("original_link"), F.col("title"), F.substring("i.description", 1, 1000).alias("summary"), F.col("i.author").alias("author"), F.col("i.category").alias("categories")])


def atom(payloads: DataFrame, kind: str = "paper") -> DataFrame:
    """Atom feeds and Atom answers of paper interfaces; an alternate link wins over others."""
    link = "array<struct<_href string, _rel string, _type string>>"
    schema = f"entry array<struct<id string, title string, updated string, published string, summary string, author array<struct<name string>>, link {link}, category array<struct<_term string>>, primary_category struct<_term string>>>"
    rows = payloads.select("source_id", F.explode(F.from_xml("payload", schema).getField("entry")).alias("e"))
    alternate = F.get(F.filter("e.link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    rows = rows.select("source_id", F.coalesce(alternate, F.get("e.link", F.lit(0))["_href"], F.col("e.id")).alias("url"), F.col("e.title").alias("title"), "e")
    return _items(rows, F.col("e.published"), F.col("e.updated"), kind, [F.col("title"), F.substring("e.summary", 1, 500).alias("abstract_snippet"), F.col("e.author.name").alias("authors"), F.array_distinct(F.array_compact(F.concat(F.array("e.primary_category._term"), F.coalesce(F.col("e.category._term"), F.array())))).alias("categories")])


def releases(payloads: DataFrame) -> DataFrame:
    """Release lists of code hosts; drafts are left out."""
    schema = "array<struct<id bigint, tag_name string, name string, body string, draft boolean, prerelease boolean, created_at string, published_at string, html_url string>>"
    rows = payloads.select("source_id", F.explode(F.from_json("payload", schema)).alias("r")).where(~F.coalesce("r.draft", F.lit(False)))
    rows = rows.select("source_id", F.col("r.html_url").alias("url"), F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), F.col("r.tag_name")).alias("title"), "r")
    return _items(rows, F.col("r.published_at"), F.col("r.created_at"), "release", [F.col("r.tag_name").alias("tag_name"), F.col("r.prerelease").alias("prerelease"), F.substring("r.body", 1, 1000).alias("body")])


def models(payloads: DataFrame, base: str = "https://huggingface.co/") -> DataFrame:
    schema = "array<struct<id string, modelId string, author string, lastModified string, createdAt string, pipeline_tag string, tags array<string>, downloads bigint, likes int>>"
    rows = payloads.select("source_id", F.explode(F.from_json("payload", schema)).alias("m"))
    name = F.coalesce("m.modelId", "m.id")
    rows = rows.select("source_id", F.concat(F.lit(base), name).alias("url"), name.alias("title"), "m")
    return _items(rows, F.col("m.lastModified"), F.col("m.createdAt"), "model", [F.col("title").alias("model_id"), F.col("m.pipeline_tag").alias("pipeline_tag"), F.col("m.downloads").alias("downloads"), F.col("m.likes").alias("likes")])


def notes(payloads: DataFrame, base: str = "https://openreview.net/forum?id=") -> DataFrame:
    """Submissions of review sites; values may be wrapped in an object."""
    schema = "notes array<struct<id string, forum string, cdate bigint, mdate bigint, content string>>"
    rows = payloads.select("source_id", F.explode(F.from_json("payload", schema).getField("notes")).alias("n"))
    value = lambda name: F.coalesce(F.get_json_object("n.content", f"$.{name}.value"), F.get_json_object("n.content", f"$.{name}"))
    rows = rows.select("source_id", F.concat(F.lit(base), F.coalesce("n.forum", "n.id")).alias("url"), value("title").alias("title"), F.timestamp_millis("n.cdate").alias("c"), F.timestamp_millis("n.mdate").alias("m"), value("abstract").alias("abstract"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _items(rows, iso(F.col("c")), iso(F.col("m")), "paper", [F.col("title"), F.substring("abstract", 1, 500).alias("abstract_snippet")])


# Classes of elements that hold one article each, where a page has no article or list elements, and of texts that sum one up.
CONTAINERS = re.compile(r"(?:^|[\s_-])(?:post|entry|article|card|news|story)(?:$|[\s_-])", re.I)
SUMMARIES = re.compile(r"summary|excerpt|description|abstract", re.I)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Links(HTMLParser):
    """Links of a page with their text, time, description and whether they stand in a frame of the page rather than its content.
    A block is an article, a list item or an element with the class of a container; the innermost one counts."""

    FRAMES = ("nav", "header", "footer", "aside")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.frames, self.link, self.text = 0, None, None

    def block(self) -> dict | None:
        return next((b for _, b in reversed(self.open) if b is not None), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag not in VOID:
            whole = tag in ("article", "li") or (tag in ("div", "section") and bool(CONTAINERS.search(given.get("class") or "")))
            self.open.append((tag, {"links": [], "time": None, "about": None} if whole else None))
            self.frames += tag in self.FRAMES
        block = self.block()
        if tag == "a" and given.get("href"):
            self.link = {"href": given["href"], "text": "", "frame": self.frames > 0, "time": block and block["time"], "about": block and block["about"], "hint": given.get("title") or ""}
        if tag == "time" and given.get("datetime") and block is not None and block["time"] is None:
            block["time"] = given["datetime"]
            for one in block["links"]:
                one["time"] = one["time"] or block["time"]
        if self.text is None and (tag == "p" or SUMMARIES.search(given.get("class") or "")) and tag not in VOID:
            self.text = (len(self.open), [])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.link is not None:
            block = self.block()
            if block is not None:
                self.link["time"], self.link["about"] = self.link["time"] or block["time"], self.link["about"] or block["about"]
                block["links"].append(self.link)
            self.found.append(self.link)
            self.link = None
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            if self.text is not None and len(self.open) <= self.text[0]:
                said, block = " ".join("".join(self.text[1]).split()), self.block()
                self.text = None
                if block is not None and block["about"] is None and len(said) > 20:
                    block["about"] = said
                    for one in block["links"]:
                        one["about"] = one["about"] or said
            name, _ = self.open.pop()
            self.frames -= name in self.FRAMES and self.frames > 0
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.link is not None:
            self.link["text"] += data
        if self.text is not None:
            self.text[1].append(data)


def html_list(pages: DataFrame, shortest_title: int = 5) -> DataFrame:
    """Articles listed on pages (source_id, url, payload): links outside of navigation with their nearest time, each
    address once a page, the first. HTML needs a real parser, so this reader alone runs in Python."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, base, page in zip(frame.source_id, frame.url, frame.payload, strict=True):
                if not page:
                    continue
                parser = _Links()
                parser.feed(page)
                for k, link in enumerate(parser.found):
                    title = " ".join((link["text"].strip() or link["hint"]).split())
                    if not link["frame"] and len(title) >= shortest_title:
                        rows.append((source, base, k, urljoin(base or "", link["href"]), link["href"], title, link["time"], link["about"]))
            yield pd.DataFrame(rows, columns=["source_id", "page", "place", "url", "href", "title", "time", "about"])

    found = pages.select("source_id", "url", "payload").mapInPandas(parse, "source_id string, page string, place int, url string, href string, title string, time string, about string")
    found = found.where(~U.is_navigation(F.col("href"))).withColumn("at", U.canonical(F.col("url")))
    first = found.groupBy("source_id", "page", "at").agg(F.min(F.struct("place", "title", "time", "about")).alias("f"))
    rows = first.select("source_id", F.col("at").alias("url"), F.col("f.title").alias("title"), F.col("f.time").alias("t"), F.col("f.about").alias("about"))
    return _items(rows, F.col("t"), F.lit(None).cast("string"), "blog", [F.col("title").alias("extracted_title"), F.col("t").alias("extracted_date_raw"), F.substring("about", 1, 500).alias("description")])


def _listed(name: str, schema: str) -> Column:
    """The entries of a payload that is an array, or an object with an array of that name."""
    return F.from_json(F.when(F.ltrim("payload").startswith("["), F.col("payload")).otherwise(F.get_json_object("payload", f"$.{name}")), schema)


def daily_papers(payloads: DataFrame, base: str = "https://arxiv.org/abs/") -> DataFrame:
    """Daily lists of papers: an array or an object with ``papers``; an entry may be nested in ``paper``. Entries without title or identifier give no rows."""
    paper = "struct<id string, paperId string, title string, publishedAt string, summary string, authors string>"
    entry = f"array<struct<paper {paper}, id string, paperId string, title string, publishedAt string, summary string, authors string, upvotes int>>"
    rows = payloads.select("source_id", F.explode(_listed("papers", entry)).alias("p"))
    pick = lambda name: F.when(F.col("p.paper").isNotNull(), F.col(f"p.paper.{name}")).otherwise(F.col(f"p.{name}"))
    some = lambda c: F.nullif(c, F.lit(""))
    number = F.coalesce(some(pick("id")), some(pick("paperId")))
    rows = rows.select("source_id", F.concat(F.lit(base), number).alias("url"), pick("title").alias("title"), F.coalesce(pick("publishedAt"), F.col("p.publishedAt")).alias("at"), number.alias("number"), pick("summary").alias("summary"), F.coalesce("p.upvotes", F.lit(0)).alias("upvotes"))
    return _items(rows, F.col("at"), F.lit(None).cast("string"), "paper", [F.col("number").alias("arxiv_id"), "upvotes", F.col("summary").alias("abstract"), F.lit(True).alias("from_hf_daily_papers"), (F.col("upvotes") > 0).alias("is_trending")])


def code_papers(payloads: DataFrame, base: str = "https://paperswithcode.com/paper/") -> DataFrame:
    """Papers of a list that names their code: an array or an object with ``results``."""
    entry = "array<struct<id string, title string, url_abs string, published string, repository_url string, proceeding string, arxiv_id string, abstract string>>"
    rows = payloads.select("source_id", F.explode(_listed("results", entry)).alias("p"))
    place = F.coalesce(F.nullif("p.url_abs", F.lit("")), F.nullif("p.id", F.lit("")))
    rows = rows.select("source_id", F.when(place.startswith("http"), place).otherwise(F.concat(F.lit(base), place)).alias("url"), F.col("p.title").alias("title"), "p")
    coded = F.coalesce(F.col("p.proceeding") != "", F.lit(False)) | F.coalesce(F.col("p.repository_url") != "", F.lit(False))
    return _items(rows, F.col("p.published"), F.lit(None).cast("string"), "paper", [F.col("p.id").alias("paper_id"), coded.alias("has_code"), F.col("p.repository_url").alias("repository_url"), F.substring("p.abstract", 1, 500).alias("abstract"), F.lit(True).alias("from_papers_with_code")])


# Names of meta tags and keys of structured data that hold dates, the surest first.
META_DATES = ("article:published_time", "og:published_time", "datePublished", "date", "pubdate")
DATA_DATES = ("datePublished", "dateCreated", "dateModified")


def page_date(html: Column) -> Column:
    """(raw, method, confidence) of a page's date: its time element, else a meta tag, else structured data, else a date in the text."""
    quoted = r"""["']([^"']+)["']"""
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])
    time = first(rf"(?is)<time\b[^>]*\bdatetime\s*=\s*{quoted}")
    meta = first(*[p for name in META_DATES for p in (rf"(?is)<meta\b[^>]*(?:property|name|itemprop)\s*=\s*[\"']{name}[\"'][^>]*\bcontent\s*=\s*{quoted}", rf"(?is)<meta\b[^>]*\bcontent\s*=\s*{quoted}[^>]*(?:property|name|itemprop)\s*=\s*[\"']{name}[\"']")])
    data = {name: first(rf'(?is)<script\b[^>]*application/ld\+json[^>]*>(?:(?!</script>).)*"{name}"\s*:\s*"([^"]+)"') for name in DATA_DATES}
    text = first(r"(?s)(?:^|>)[^<>]*?\b(\d{4}-\d{2}-\d{2})\b", r"(?s)(?:^|>)[^<>]*?\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4})\b")
    later = F.coalesce(data["dateCreated"], data["dateModified"])
    raw = F.coalesce(time, meta, data["datePublished"], later, text)
    structured = F.coalesce(data["datePublished"], later)
    method = F.when(time.isNotNull(), "time").when(meta.isNotNull(), "meta").when(structured.isNotNull(), "json_ld").when(text.isNotNull(), "text").otherwise("none")
    sure = time.isNotNull() | meta.isNotNull() | data["datePublished"].isNotNull()
    return F.struct(raw.alias("raw"), method.alias("method"), F.when(sure, "high").when(raw.isNotNull(), "medium").otherwise("low").alias("confidence"))
