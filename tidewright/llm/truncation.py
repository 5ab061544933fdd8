"""Texts that were cut by a field limit or in transfer.

A backward character n-gram model is trained on the tables themselves: for the suffixes of ``ORDERS`` lengths,
how often a text ends right after them and how often it goes on, and whether it goes on inside the same word.
Counts cover every text and every position. Only contexts that are some value's final context are counted; they live in
tables of fixed size (``BITS``), one context a bucket with a check value: of several the one that ends most texts, and
texts that end in the others are scored by their shorter contexts. So the model that is sent to the tasks has a
size that doesn't depend on the data, and no count is ever the sum of two contexts.

A value's final context, without white space and without a mark of a cut, is scored by the log-odds of ending
against going on, in the longest context with enough evidence, leaving the value itself out. The threshold per
language and column is the one that best separates the values as they are from the same values cut at a
random place; a column whose ends can't be told from cuts (``LEAST_GAIN``) has none. Exact checks follow the model: a text that stops
inside a word, leaves a bracket, fence, tag or entity open, hangs on a word or sign that needs a continuation, or
carries an unmistakable mark, was cut whatever its odds; closed code blocks, and values without any blank (names, addresses,
numbers) were not cut by odds; of a text that only repeats the record's title nothing but a mark tells a cut.

Of ``items.raw_json`` the JSON itself is checked (it was cut where it ends inside a value or container) and,
where it can be read, every string in it at any depth, by its key as column. Nulls, blanks and placeholders were not cut. An
empty table gives an empty result; repeated rows each count; more columns in the tables change nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_name
from tidewright.session import cut_lineage, written

ORDERS = (1, 2, 3, 5, 8)
#: log2 of the buckets per order, each with one context: 22 MB of counts and check values in all.
BITS = (14, 16, 18, 19, 19)
#: A context decides if it was seen so often apart from the value itself.
EVIDENCE = 8
#: A threshold must leave below it so many more of the cut than twice the uncut values (as shares).
LEAST_GAIN = 0.3

# Marks of a cut that say so, and signs that may also end a complete text.
_SURE_MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)?\s*\]?|\(\s*(?:\.\.\.|…)\s*\)|&hellip;|&#8230;|[\[(](?:truncated|cut|continued|more|read more)\b[^\])]{0,12}[\])]?)$", re.I)
_MARK = re.compile(r"\s*(?:\.{3,}|…+|⋯+)$")
_URL = re.compile(r"(https?://[^\s/]+/)[^\s)\]]+")
_TAG = re.compile(r"#\w+")
# Words after which a text can't end.
_HANGING = re.compile(
    r"(?:a|an|the|of|to|in|on|at|by|for|from|with|without|and|or|nor|but|as|than|that|which|whose|into|onto|between|because|"
    r"while|whether|if|is|are|was|were|be|its|their|our|your|this|these|those|e\.g\.|i\.e\.|cf\.|vs\.|incl\.|see|via|per)",
    re.I,
)
_OPEN_SIGN = ",;:，；：、(（[{「『《<@=+&/\\-"
_BROKEN_END = re.compile(r"(?:&[A-Za-z]{1,8}|&#\w{0,6}|<[A-Za-z/][^<>]{0,80}|\]\([^)\s]*|\[[^\]\n]{0,60}\]\([^)]*)$")
_EMPTY_TABLE = re.compile(r"\|[^\n]*\|\s*\n\s*\|[\s:|-]+\|?$")
_SENTENCE_END = re.compile(r"(?:[A-Za-z)\]\"”’'%][.!?][\"”’')\]]*|[。！？][」』）)\"”]*)$")
_SENTENCE = re.compile(r"[.!?](?:\s|$)|[。！？]")
#: Values without a blank and without signs of these scripts are names, addresses or numbers.
_PROSE = re.compile(r"\s|[぀-ヿ㐀-鿿가-힯]")
# What stands where a text is missing.
_PLACEHOLDER = re.compile(r"^\W*(?:n/?a|none|null|nil|tbd|todo|untitled|無|无|略|空)?\W*$", re.I)
_COMPLETE_URL = re.compile(r"https?://[^\s/]+/\S+$")
_BRACKET = re.compile(r"[()（）\[\]「」『』《》]")
_KANA, _HANGUL, _HAN = re.compile(r"[぀-ヿ]"), re.compile(r"[가-힯]"), re.compile(r"[一-鿿]")
_BRACKETS = {")": "(", "）": "（", "]": "[", "」": "「", "』": "『", "》": "《"}
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [pow(0x100000001B3, k, 1 << 64) for k in range(max(ORDERS))]


def stripped(text: str) -> tuple[str, bool]:
    """The text without trailing white space and mark of a cut; whether the mark leaves no doubt."""
    bare = text.rstrip()
    if bare.endswith("\ufffd"):
        return bare.rstrip("\ufffd").rstrip(), True
    tail = bare[-24:]
    # without one of these signs no pattern can match
    found = _SURE_MARK.search(tail) if "[" in tail or "(" in tail or tail.endswith(";") else None
    if found:
        return bare[: len(bare) - len(tail) + found.start()].rstrip(), True
    found = _MARK.search(tail) if tail.endswith(("...", "…", "⋯")) else None
    return (bare[: len(bare) - len(tail) + found.start()].rstrip(), False) if found else (bare, False)


def normal(text: str) -> str:
    """The view the model counts: lower case, paths and tags as one sign."""
    if "://" in text:
        text = _URL.sub(r"\1x", text)
    if "#" in text:
        text = _TAG.sub("#x", text)
    return text.lower()


def language(text: str) -> str:
    tail = text[-80:]
    if tail.isascii():
        return "latin"
    if _KANA.search(tail):
        return "ja"
    if _HANGUL.search(tail):
        return "ko"
    return "zh" if len(_HAN.findall(tail)) * 4 > len(tail) else "latin"


def open_ended(bare: str) -> bool:
    """Whether the end, already without a mark, can't be one."""
    if not bare:
        return False
    tail, last = bare[-120:], bare[-1]
    if last in _OPEN_SIGN or (last in ":|-" and _EMPTY_TABLE.search(bare[-300:])):
        return True
    if ("&" in tail or "<" in tail or "](" in tail) and _BROKEN_END.search(tail):
        return True
    word = tail.split()[-1].rpartition("(")[2] if not last.isspace() else ""
    if _HANGING.fullmatch(word):
        return True
    if bare.count("```") % 2:
        return True
    depth: dict[str, int] = {}
    for sign in _BRACKET.findall(bare[-400:].rpartition("\n")[2]):
        if sign in _BRACKETS:
            mate = _BRACKETS[sign]
            depth[mate] = max(0, depth.get(mate, 0) - 1)
        else:
            depth[sign] = depth.get(sign, 0) + 1
    return any(depth.values())


def json_cut(text: str) -> tuple[bool, dict | None]:
    """Whether a JSON text stops before its end; its object, where it can be read."""
    bare = text.lstrip("﻿ \t\r\n").rstrip()
    if not bare:
        return False, None
    try:
        value = json.loads(bare)
        return False, value if isinstance(value, dict) else None
    except ValueError:
        pass
    inside, escaped, depth, quote = False, False, 0, "'" if bare[:2] in ("{'", "['") else '"'
    if quote == "'":
        return bare[-1] not in "}]", None
    for sign in re.findall(r'[\\"{}\[\]]|[^\\"{}\[\]]+', bare):
        if inside:
            if escaped:
                escaped = False
            elif sign == "\\":
                escaped = True
            elif sign == '"':
                inside = False
        elif sign == '"':
            inside = True
        elif sign in "{[":
            depth += 1
        elif sign in "}]":
            depth -= 1
    return bare[0] in '{["' and (inside or depth > 0), None


def _synthetic(bare: str) -> int:
    """A place inside the text that depends on nothing but the text."""
    return max(1, int(len(bare) * (0.3 + 0.65 * (zlib.crc32(bare.encode("utf-8", "replace")) % 1000) / 1000)))


def strings_in(value: object, key: str = "") -> Iterator[tuple[str, str]]:
    """Every string of a JSON value with the key it stands under, at any depth."""
    open_ = [(key, value)]
    while open_:
        key, value = open_.pop()
        if isinstance(value, str):
            yield key, value
        elif isinstance(value, dict):
            open_ += list(value.items())
        elif isinstance(value, list):
            open_ += [(key, x) for x in value]


_VALUES = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("source", pa.string()), ("field", pa.string()), ("cut", pa.bool_()), ("title", pa.bool_()), ("text", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text: of items one for the JSON itself where it is cut, and one for every string in it."""
    for batch in batches:
        out: list[tuple] = []
        cols = [batch.column(c).to_pylist() for c in ("tbl", "row_id", "source", "title", "text")]
        for tbl, row, source, title, text in zip(*cols, strict=True):
            if text is None:
                continue
            if tbl != "items":
                out.append((tbl, row, source, tbl, False, _same(text, title), text))
                continue
            cut, value = json_cut(text)
            other = None if title is None else _words(title)
            # names, addresses and numbers, without any blank, end anywhere: nothing but a mark tells that they were cut
            parts = [(key, part) for key, part in strings_in(value) if _PROSE.search(part.strip()) or part.endswith((".", "…", "]", ")", ";", "\ufffd"))]
            if cut or not parts:
                # a readable record without any text still counts
                out.append((tbl, row, source, "raw_json", cut, False, None))
            out += [(tbl, row, source, key, False, _same(part, title, other), part) for key, part in parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_VALUES), _VALUES, strict=True)], schema=_VALUES)


_WORD = re.compile(r"\w+")


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.casefold()))


def _same(text: str, title: str | None, other: set[str] | None = None) -> bool:
    """Whether the text only repeats the record's title, as far as spelling and additions allow. ``other``: the title's words, where they are known."""
    if not title or len(text) > 2 * len(title) + 40:
        return False
    own, other = _words(text), _words(title) if other is None else other
    return bool(own) and 2 * len(own & other) >= len(own | other)


class Suffixes:
    """Suffixes of many texts, laid end to end, hashed where they are asked for."""

    def __init__(self, texts: list[str]):
        joined = "\n\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths + 2) - 3  # last position of each text
        number = (codes >= 48) & (codes <= 57)
        codes = np.where(number, np.uint32(57), codes)
        kept = np.ones(len(codes), dtype=bool)
        kept[1:] = ~(number[1:] & number[:-1])
        place = np.cumsum(kept) - 1
        self.ends = place[np.minimum(ends, len(codes) - 1)] if len(codes) else ends
        self.place, self.starts = place, place[np.minimum(ends - lengths + 1, len(codes) - 1)] if len(codes) else ends
        self.raw_starts = ends - lengths + 1
        self.codes = codes[kept].astype(np.uint64)
        letter = (self.codes >= 97) & (self.codes <= 122)
        self.inside = np.zeros(len(self.codes), dtype=bool)
        self.inside[:-1] = letter[:-1] & letter[1:]
        self.letter = letter
        index = np.arange(len(self.codes))
        begun = np.zeros(len(self.codes), dtype=np.int64)
        if len(texts):
            begun[self.starts] = self.starts
            begun = np.maximum.accumulate(begun)
        self.depth = index - begun + 1
        self.body = np.ones(len(self.codes), dtype=bool)
        if len(texts):
            for off in (0, 1, 2):
                self.body[np.minimum(self.ends + off, len(self.codes) - 1)] = False

    @property
    def hashes(self) -> dict[int, np.ndarray]:
        return {ORDERS[o]: bucket for o, bucket, _ in self.everywhere()}

    @property
    def checks(self) -> dict[int, np.ndarray]:
        return {ORDERS[o]: check for o, _, check in self.everywhere()}

    @staticmethod
    def _mixed(running: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and check values of sums of codes."""
        mixed = running >> np.uint64(29)
        mixed ^= running
        mixed *= _FACTOR
        return (mixed >> np.uint64(64 - BITS[o])).view(np.int64), mixed.astype(np.uint32)

    def at(self, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By order, the buckets and check values of the suffixes that end at some places; those longer than their text mean nothing."""
        running, done = np.zeros(len(places), dtype=np.uint64), 0
        for o, order in enumerate(ORDERS):
            for k in range(done, order):
                running += self.codes[np.maximum(places - k, 0)] * np.uint64(_POWERS[k])
            done = order
            yield o, *self._mixed(running, o)

    def everywhere(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By order, those of all places."""
        running, done = np.zeros(len(self.codes), dtype=np.uint64), 0
        for o, order in enumerate(ORDERS):
            for k in range(done, order):
                running[k:] += self.codes[: len(self.codes) - k] * np.uint64(_POWERS[k])
            done = order
            yield o, *self._mixed(running, o)


#: Texts at once; where all their places are hashed, so few that the arrays stay in a CPU's cache, and places counted at once.
_SIZE, _SMALL, _COUNTED = 12_000, 1_000, 1 << 20


def _groups(batches: Iterator[pa.RecordBatch], size: int = _SIZE) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, bool]], list[str]]]:
    """Pieces of batches, their texts without marks of a cut (and whether the mark leaves no doubt), and those that aren't blank as the model sees them."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            piece = batch.slice(at, size)
            found = [("", False) if text is None else stripped(text) for text in piece.column("text").to_pylist()]
            yield piece, found, [normal(text) for text, _ in found if text]


def _places(s: Suffixes, texts: list[str]) -> np.ndarray:
    """Where the synthetic cuts fall."""
    return s.place[s.raw_starts + np.array([min(len(t) - 1, _synthetic(t)) for t in texts], dtype=np.int64)] if texts else s.ends


_ENDS = pa.schema([("o", pa.int32()), ("b", pa.int32()), ("f", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])
_GOES = pa.schema([("o", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("m", pa.int64())])


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By context (bucket and check value), n: texts that end after it; m: synthetic cuts that fall there."""
    for _, _, texts in _groups(batches):
        s = Suffixes(texts)
        cuts = _places(s, texts)
        places, falls = np.concatenate([s.ends, cuts]), np.arange(2 * len(texts)) >= len(texts)
        depth = s.depth[places]
        for o, bucket, check in s.at(places):
            deep = depth >= ORDERS[o]
            unique, inverse = np.unique(bucket[deep].astype(np.uint64) << np.uint64(32) | check[deep], return_inverse=True)
            n, both = np.bincount(inverse[~falls[deep]], minlength=len(unique)), np.bincount(inverse, minlength=len(unique))
            columns = [np.full(len(unique), o, dtype=np.int32), (unique >> np.uint64(32)).astype(np.int32), (unique & np.uint64(0xFFFFFFFF)).astype(np.int64), n.astype(np.int64), (both - n).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ENDS)


def contexts(values: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order and bucket the check value of the context kept there and how many texts end after it (0: none is kept). Both
    tables are on the driver; their size is bounded by ``BITS``. Counts are added up as whole numbers of 64 bits; the tables hold
    them as floats, near enough for log-odds at any size."""
    counted = values.mapInArrow(_count_ends, "o int, b int, f bigint, n bigint, m bigint").groupBy("o", "b", "f").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    kept = counted.groupBy("o", "b").agg(F.max(F.struct((F.col("n") + F.col("m")).alias("w"), "n", "f")).alias("k")).select("o", "b", F.col("k.f").alias("f"), F.col("k.n").alias("n")).toArrow()
    checks, ends = [np.zeros(1 << b, dtype=np.uint32) for b in BITS], [np.zeros(1 << b, dtype=np.float32) for b in BITS]
    o, b = kept.column("o").to_numpy(), kept.column("b").to_numpy()
    for k in range(len(ORDERS)):
        checks[k][b[o == k]], ends[k][b[o == k]] = kept.column("f").to_numpy()[o == k], kept.column("n").to_numpy()[o == k]
    return checks, ends


def _count_goings_on(wanted) -> object:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n: positions after which the text goes on; m: those of them inside a word."""
        checks = wanted.value
        n, m = ([np.zeros(1 << b, dtype=np.int64) for b in BITS] for _ in range(2))
        met: list[list[np.ndarray]] = [[] for _ in ORDERS]
        inner: list[list[np.ndarray]] = [[] for _ in ORDERS]

        def add(total: np.ndarray, found: list[np.ndarray], least: int) -> None:
            if sum(map(len, found)) > least:
                total += np.bincount(np.concatenate(found), minlength=len(total))
                found.clear()

        for _, _, texts in _groups(batches, _SMALL):
            s = Suffixes(texts)
            for o, bucket, check in s.everywhere():
                at = np.flatnonzero((checks[o][bucket] == check) & s.body & (s.depth >= ORDERS[o]))
                known = bucket[at].astype(np.int32)
                met[o].append(known)
                inner[o].append(known[s.inside[at]])
                add(n[o], met[o], _COUNTED)
                add(m[o], inner[o], _COUNTED)
        for o in range(len(ORDERS)):
            add(n[o], met[o], 0)
            add(m[o], inner[o], 0)
        for o in range(len(ORDERS)):
            at = np.flatnonzero(n[o])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), o, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(n[o][at]), pa.array(m[o][at])], schema=_GOES)

    return count


def goings_on(values: DataFrame, wanted) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order and bucket how often texts go on after the context kept there, and how often inside a word."""
    found = values.mapInArrow(_count_goings_on(wanted), "o int, b int, n bigint, m bigint").groupBy("o", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    n, m = ([np.zeros(1 << b, dtype=np.float32) for b in BITS] for _ in range(2))
    o, b = found.column("o").to_numpy(), found.column("b").to_numpy()
    for k in range(len(ORDERS)):
        n[k][b[o == k]], m[k][b[o == k]] = found.column("n").to_numpy()[o == k], found.column("m").to_numpy()[o == k]
    return n, m


_SCORED = "tbl string, row_id bigint, source string, field string, lang string, sure boolean, settled boolean, score double, synthetic double"


def _score(model) -> object:
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("source", pa.string()), ("field", pa.string()), ("lang", pa.string()),
                        ("sure", pa.bool_()), ("settled", pa.bool_()), ("score", pa.float64()), ("synthetic", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks, ends, goes, within = model.value

        def odds(s: Suffixes, at: np.ndarray, own_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            result, inside, best = np.full(len(at), np.nan), np.zeros(len(at), dtype=bool), np.full(len(at), -np.inf)
            for o, bucket, check in s.at(at):  # longer contexts overwrite
                order = ORDERS[o]
                e, g, w = np.maximum(ends[o][bucket] - own_end, 0), np.maximum(goes[o][bucket] - (1 - own_end), 0), within[o][bucket]
                fits = (s.depth[at] >= order) & (e + g >= EVIDENCE) & (checks[o][bucket] == check)
                result[fits] = np.log((e[fits] + 0.2) / (g[fits] + 1.0))
                best[fits] = np.maximum(best[fits], result[fits])
                if order > 2:
                    inside[fits] = (w[fits] > 0.95 * (g[fits] + e[fits])) & s.letter[at[fits]]
            return result, inside, best

        for piece, found, texts in _groups(batches):
            s = Suffixes(texts)
            natural, midword, best = odds(s, s.ends, 1) if texts else (np.zeros(0),) * 3
            synthetic, _, _ = odds(s, _places(s, texts), 0) if texts else (natural,) * 3
            cuts, same = (piece.column(c).to_pylist() for c in ("cut", "title"))
            langs, sures, settled, ended, told = [], [], [], [], []
            midword = midword.tolist()
            for row, (bare, marked) in enumerate(found):
                if not bare:
                    langs.append("none"), sures.append(cuts[row]), settled.append(True)
                    continue
                prose = bool(_PROSE.search(bare)) and not _PLACEHOLDER.match(bare)
                hanging = midword[len(told)] and not _COMPLETE_URL.search(bare[-200:])
                langs.append(language(bare))
                sures.append(marked or (prose and not same[row] and (hanging or open_ended(bare))))
                settled.append(not prose or same[row] or bare.endswith("```"))
                ended.append(_SENTENCE_END.search(bare[-12:]) is not None)
                told.append(row)
            scores = (_numbers(v, told, len(found)) for v in (np.where(np.array(ended, dtype=bool), best, natural), synthetic))
            columns = [*(piece.column(c) for c in ("tbl", "row_id", "source", "field")), pa.array(langs, pa.string()), pa.array(sures, pa.bool_()), pa.array(settled, pa.bool_()), *scores]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return score


def _numbers(values: np.ndarray, rows: list[int], size: int) -> pa.Array:
    """The finite ones of the values at their rows, null elsewhere."""
    out = np.full(size, np.nan)
    out[rows] = values
    return pa.array(out, mask=~np.isfinite(out))


def scored_values(texts: DataFrame) -> DataFrame:
    """``texts``: tbl, row_id, source, title, text. One row per value with the log-odds of its end and the exact checks."""
    context = texts.sparkSession.sparkContext
    # JSON is read once; the three passes of the model see a narrow table of texts
    values = written(texts.mapInArrow(_read, "tbl string, row_id bigint, source string, field string, cut boolean, title boolean, text string"))
    checks, ends = contexts(values.select("text"))
    wanted = context.broadcast(checks)
    goes, within = goings_on(values.select("text"), wanted)
    wanted.destroy()
    return cut_lineage(values.mapInArrow(_score(context.broadcast((checks, ends, goes, within))), _SCORED))


def thresholds(scored: DataFrame) -> DataFrame:
    """(field, lang, threshold): the log-odds that best separate values as they are from values cut at random."""
    step = 0.25
    place = lambda name: F.floor(F.col(name) / step).cast("int")
    both = scored.select("field", "lang", place("score").alias("at"), F.lit(1).alias("natural"), F.lit(0).alias("cut")).unionByName(
        scored.select("field", "lang", place("synthetic").alias("at"), F.lit(0).alias("natural"), F.lit(1).alias("cut"))
    )
    bins = both.where(F.col("at").isNotNull()).groupBy("field", "lang", "at").agg(F.sum("natural").alias("natural"), F.sum("cut").alias("cut"))
    whole, below = Window.partitionBy("field", "lang"), Window.partitionBy("field", "lang").orderBy("at")
    gain = F.sum("cut").over(below) / F.sum("cut").over(whole) - 2 * F.sum("natural").over(below) / F.sum("natural").over(whole)
    ranked = bins.withColumn("gain", F.round(gain, 4)).withColumn("best", F.max("gain").over(whole))
    # halfway between the first and the last place that separate about equally well
    best = ranked.where((F.col("gain") >= F.col("best") - 0.01) & (F.col("best") >= LEAST_GAIN)).groupBy("field", "lang").agg(F.avg("at").alias("at"))
    return best.select("field", "lang", ((F.col("at") + 1) * step).alias("threshold"))


def texts_of(translations: DataFrame, releases: DataFrame, items: DataFrame) -> DataFrame:
    def pick(df: DataFrame, name: str, source: str, title: str, text: str) -> DataFrame:
        given = F.col(title) if title in df.columns else F.lit(None).cast("string")
        by = canonical_name(F.col(source)) if source == "source_id" else F.col(source)
        return df.select(F.lit(name).alias("tbl"), "row_id", by.alias("source"), given.alias("title"), F.col(text).alias("text"))

    return (
        pick(translations, "translations_zh", "model", "title_zh", "summary_zh")
        .unionByName(pick(releases, "releases", "source_id", "name", "body"))
        .unionByName(pick(items, "items", "source_id", "title", "raw_json"))
    )


def judged(scored: DataFrame) -> DataFrame:
    """(tbl, row_id, source, cut): one row per record that has a text."""
    limits = thresholds(scored)
    cut = F.col("sure") | (~F.col("settled") & F.coalesce(F.col("score") < F.col("threshold"), F.lit(False)))
    return scored.join(limits, ["field", "lang"], "left").groupBy("tbl", "row_id", "source").agg(F.max(cut).alias("cut"))


def cut_records(translations: DataFrame, releases: DataFrame, items: DataFrame) -> DataFrame:
    """(tbl, row_id) of each record whose text was cut."""
    return judged(scored_values(texts_of(translations, releases, items))).where("cut").select("tbl", "row_id")


def rates(records: DataFrame) -> DataFrame:
    """(tbl, source, texts, cut, share) of :func:`judged` records; a record without source counts under null."""
    counted = records.groupBy("tbl", "source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))
    return counted.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
