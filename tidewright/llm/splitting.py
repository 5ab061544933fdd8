"""Cutting texts above a size into pieces at natural boundaries, by packing a structure tree.

A text is read as a tree: headings by depth, then blocks between blank lines, then lines and list items by how far they are
indented (of HTML lists by how deep they are nested), so that an item holds what is indented below it, then sentences, then
clauses, then words, then single tokens. A node that fits is a leaf. An oversized node is
descended into; the pieces of its children are merged with their siblings, left to right, as long as the sum
fits. So a cut falls at the highest boundary that can hold, and words are cut only where a single word exceeds
the size. Code fences hold their lines together: headings and blank lines inside don't count.

Sizes are tokens of the whole text's own encoding; a piece is a run of them, and may have a few tokens more or less when it
is encoded by itself. Each piece but the first repeats,
in front, as many whole words as fit into ``overlap`` tokens (tokens, where a word is longer); overlap and rest
together stay within ``limit``, and the first piece, without overlap, may fill it. Texts within the limit are one piece; null and
empty texts are one piece of size 0 with a null or empty text. Concatenating the pieces without their overlaps gives the text back.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm import bpe

LIMIT = 512
OVERLAP = 48

_FENCE = re.compile(rb"^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.M | re.S)
_HEADING = re.compile(rb"^[ \t]{0,3}(#{1,6})[ \t]|^[ \t]{0,3}<h([1-6])\b|^(?=[^\n]+\n(?:={3,}|-{3,})[ \t]*$)", re.M | re.I)
_BLOCK = re.compile(rb"\n[ \t\r]*\n[ \t\r\n]*|<(?:p|div|table|section|article)\b[^>]*>", re.I)
_LINE = re.compile(rb"\r\n?|\n|\xe2\x80\xa8|\xe2\x80\xa9|\x0b|\x0c|\xc2\x85|<br\s*/?>", re.I)
_SENTENCE = re.compile(rb"(?:[.!?][\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)(?:\xe3\x80\x8d|\xe3\x80\x8f|\xef\xbc\x89|\xe2\x80\x9d)*")
_CLAUSE = re.compile(rb"[,;:](?=\s)|\xef\xbc\x8c|\xe3\x80\x81|\xef\xbc\x9b|\xef\xbc\x9a| \xe2\x80\x93 | \xe2\x80\x94 ")
_LIST = re.compile(rb"<(/?)(ul|ol|li)\b[^>]*>", re.I)
_INDENT = re.compile(rb"[ \t]*")
#: Depths of the tree, from whole sections (1 to 6) to single tokens. Lines have a depth for each level of indentation.
BLOCK, LINE, SENTENCE, CLAUSE, WORD, TOKEN = 7, 8, 28, 29, 30, 31
LEVELS = 19


def boundaries(text: bytes) -> dict[int, int]:
    """Byte position of each place where something begins -> its depth (1 to 6: a heading's)."""
    found: dict[int, int] = {}
    fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)] if b"```" in text or b"~~~" in text else []

    fence_starts = [f[0] for f in fences]

    def fenced(at: int) -> bool:
        k = bisect_left(fence_starts, at) - 1
        return k >= 0 and at < fences[k][1]

    def note(at: int, depth: int) -> None:
        if 0 < at < len(text) and found.get(at, TOKEN) > depth:
            found[at] = depth

    def level(at: int) -> int:
        """How far the line that begins at ``at`` is indented, two blanks a level."""
        return min(LEVELS, len(_INDENT.match(text, at)[0].replace(b"\t", b"    ")) // 2)

    for m in _HEADING.finditer(text):
        if not fenced(m.start()):
            note(m.start(), len(m[1]) if m[1] else int(m[2]) if m[2] else 1)
    for m in _BLOCK.finditer(text):
        if not fenced(m.start()):
            if m[0][:1] != b"\n":
                note(m.start(), BLOCK)
            else:  # what is indented below a blank line still belongs to what stands above it
                begin = text.rfind(b"\n", 0, m.end()) + 1
                note(m.end(), BLOCK if level(begin) == 0 else LINE + level(begin))
    for a, b in fences:
        note(a, BLOCK)
        note(b, BLOCK)
    nested = 0
    for m in _LIST.finditer(text):
        if m[2].lower() != b"li":
            nested = max(0, nested + (-1 if m[1] else 1))
        elif not m[1]:
            note(m.start(), LINE + min(LEVELS, nested))
    for m in _LINE.finditer(text):
        note(m.end(), LINE + level(m.end()))
    for pattern, depth in ((_SENTENCE, SENTENCE), (_CLAUSE, CLAUSE)):
        for m in pattern.finditer(text):
            note(m.end(), depth)
    return found


def spans(places: np.ndarray, depths: np.ndarray, sizes: np.ndarray, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Runs [from, to) of atoms, of at most ``limit`` tokens less the ``overlap`` that all but the first repeat. ``sizes``: tokens up to each atom, and of all; ``depths``: of each atom's start."""
    found: list[tuple[int, int]] = []

    def weight(a: int, b: int) -> int:
        return int(sizes[b] - sizes[a])

    def fits(a: int, b: int) -> bool:
        return weight(a, b) <= (limit - overlap if a else limit)

    def descend(a: int, b: int) -> list[tuple[int, int]]:
        if fits(a, b) or b - a == 1:
            return [(a, b)]
        inner = depths[a + 1 : b]
        top = inner.min()
        cuts = [a, *(np.flatnonzero(inner == top) + a + 1).tolist(), b]
        merged: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            for piece in [(x, y)] if fits(x, y) else descend(x, y):
                if merged and fits(merged[-1][0], piece[1]):
                    merged[-1] = (merged[-1][0], piece[1])
                else:
                    merged.append(piece)
        return merged

    if len(places):
        found = descend(0, len(places))
    return found


def _atoms(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte position, depth (WORD or TOKEN) and tokens of the smallest parts: pre-tokens, long ones token by token."""
    at_token = starts[0] + np.cumsum(token_bytes[ids]) - token_bytes[ids]
    begins = np.cumsum(counts) - counts
    word = np.zeros(len(ids), dtype=bool)
    word[begins] = True
    long = np.repeat(counts > 8, counts)
    whole = np.zeros(len(ids), dtype=bool)
    whole[word] = True
    inside = long & ~word
    if inside.any():
        where = np.flatnonzero(inside)
        whole[where[(text[at_token[where]] & 0xC0) != 0x80]] = True
    kept = np.flatnonzero(whole)
    return at_token[kept], np.where(word[kept], WORD, TOKEN), np.diff(np.append(kept, len(ids)))


def split_text(data: bytes, padded: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, tool: bpe.Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(from, begin, to, tokens) in bytes: the piece is data[from:to], new from ``begin`` on."""
    places, depths, tokens = _atoms(padded, starts, counts, ids, tool.token_bytes)
    depths = depths.astype(np.int64)
    marks = boundaries(data)
    at = np.searchsorted(places, np.fromiter(marks.keys(), dtype=np.int64, count=len(marks)))
    depth = np.fromiter(marks.values(), dtype=np.int64, count=len(marks))
    inside = (at > 0) & (at < len(places))
    np.minimum.at(depths, at[inside], depth[inside])
    sizes = np.concatenate([[0], np.cumsum(tokens)])
    result = []
    for a, b in spans(places, depths, sizes, limit, overlap):
        first = a
        if a > 0:  # as many whole atoms as fit
            room = min(overlap, limit - int(sizes[b] - sizes[a]))
            first = min(a, int(np.searchsorted(sizes, sizes[a] - room)))
        end = int(places[b]) if b < len(places) else len(data)
        result.append((int(places[first]), int(places[a]), end, int(sizes[b] - sizes[first])))
    return result


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, identifier: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = bpe.FOLDER) -> DataFrame:
    """(identifier, piece, overlap, tokens, text): the pieces of each document in order; ``overlap`` counts the
    characters at the front that repeat the end of the piece before."""
    assert 0 <= overlap < limit
    shared = documents.sparkSession.sparkContext.broadcast(bpe.encoder(name, folder))
    kind = dict(documents.dtypes)[identifier]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found: list[tuple[int, int, int, int, str | None]] = [(row, 0, 0, 0, t) for row, t in enumerate(texts.to_pylist()) if not t]
            for rows_, data, edges, tokens_, starts, counts in tool.chunks(texts):
                begins = np.append(np.searchsorted(starts, edges[:-1]), len(starts))
                before = np.concatenate([[0], np.cumsum(counts)])
                for k, row in enumerate(rows_.tolist()):
                    a, b = int(begins[k]), int(begins[k + 1])
                    low, high = int(edges[k]), int(edges[k + 1])
                    size = int(before[b] - before[a])
                    own = data[low:high].tobytes()
                    if size <= limit:
                        found.append((row, 0, 0, size, own.decode("utf-8", "replace")))
                        continue
                    parts = split_text(own, data[low : high + 8], starts[a:b] - low, counts[a:b], tokens_[before[a] : before[b]], tool, limit, overlap)
                    for piece, (start, begin, end, n) in enumerate(parts):
                        again = len(own[start:begin].decode("utf-8", "replace")) if begin > start else 0
                        found.append((row, piece, again, n, own[start:end].decode("utf-8", "replace")))
            rows, number, again, tokens, out = ([f[k] for f in found] for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, type=pa.int64())), pa.array(number, type=pa.int32()), pa.array(again, type=pa.int32()), pa.array(tokens, type=pa.int64()), pa.array(out, type=pa.string())],
                names=[identifier, "piece", "overlap", "tokens", "text"],
            )

    return documents.select(identifier, text).mapInArrow(split, f"`{identifier}` {kind}, piece int, overlap int, tokens bigint, text string")
