"""Byte-pair encoding of a whole corpus with a public byte-level vocabulary, in two tiers.

Texts are split into pre-tokens by array operations over all texts of a batch at once, straight on the UTF-8
bytes Arrow delivers. A pre-token that is itself an entry of the vocabulary is resolved by a minimal perfect
hash: one displacement and one slot per key, no empty slots, and an exact comparison of the bytes. The others
are merged one by one with a heap of candidate pairs over a linked list of byte positions, once per distinct
pre-token of a batch and remembered per worker in a table of fixed size.

Null and empty texts give the empty list; special tokens are ordinary text; blanks, repeated rows and texts of
any length need no special care. The vocabulary file stays outside the repository, its path is a parameter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie on this machine; every operator takes another folder.
FOLDER = "/opt/tokenizers"
#: Distinct merged pre-tokens a worker remembers.
REMEMBERED = 200_000
#: Bytes that are split and looked up together.
CHUNK = 1 << 20

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Code points with the White_Space property.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[_WHITE] = SPACE
    return table


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; needs eight spare bytes at the end."""
    return np.ndarray(shape=(len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))


def _hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    h = lengths.astype(np.uint64) * _K1
    open_, at, left = slice(None), starts, lengths
    while True:
        part = words[at] & _MASK[np.minimum(left, 8)]
        mixed = (h[open_] ^ (part * _K2)) * _K3
        h[open_] = mixed ^ (mixed >> np.uint64(31))
        longer = np.flatnonzero(left > 8)
        if not len(longer):
            return h
        open_ = longer if isinstance(open_, slice) else open_[longer]
        at, left = at[longer] + 8, left[longer] - 8


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` on are those from ``b`` on, eight a round."""
    same = size_a == size_b
    open_ = np.flatnonzero(same & (a != b))
    a, b, left = a[open_], b[open_], size_a[open_]
    while len(open_):
        mask = _MASK[np.minimum(left, 8)]
        equal = (words[a] & mask) == (words[b] & mask)
        same[open_[~equal]] = False
        further = np.flatnonzero(equal & (left > 8))
        open_, a, b, left = open_[further], a[further] + 8, b[further] + 8, left[further] - 8
    return same


class Encoder:
    """The vocabulary with its perfect hash and merges."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[int, int]):
        self.merges = merges  # (left << 16 | right) -> merged id; lower ids merge first
        keys = sorted(vocabulary, key=vocabulary.__getitem__)
        self.n = len(keys)
        lengths = np.array([len(k) for k in keys], dtype=np.int64)
        data = np.frombuffer(b"".join(keys) + b"\0" * 8, dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        h = _hashes(_words(data), starts, lengths)
        self.displace, slots = _perfect(h, self.n)
        self.ids, self.length_at, self.start_at = (np.empty(self.n, dtype=t) for t in (np.int32, np.int64, np.int64))
        self.ids[slots] = [vocabulary[k] for k in keys]
        self.length_at[slots], self.start_at[slots] = lengths, starts
        self.data = data
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        #: bytes of each token, by id
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.token_bytes[[vocabulary[k] for k in keys]] = lengths
        self.memory: dict[bytes, np.ndarray] = {}
        self.classes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}, "classes": None}

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Encoder:
        """From ``folder/name.json``: the vocabulary in its printable alphabet and the ordered merges."""
        with open(f"{folder}/{name}.json", encoding="utf-8") as file:
            model = json.load(file)["model"]
        printable = _printable()
        special = {"<|endoftext|>"}
        vocabulary = {bytes(printable[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges, last = {}, -1
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = model["vocab"][left + right]
            if made <= last or max(model["vocab"][left], model["vocab"][right]) >= 1 << 16:
                raise ValueError(f"{name}: merges must be listed by ascending id, of at most 16 bits")
            merges[model["vocab"][left] << 16 | model["vocab"][right]], last = made, made
        return cls(vocabulary, merges)

    # pre-tokens

    def split(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens start. ``firsts``: where the (non-empty) texts start."""
        if self.classes is None:
            self.classes = _classes()
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        code = data[at].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
            p, b = at[wide], code[wide]
            b1, b2, b3 = (padded[p + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
            code[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | b1, np.where(b < 0xF0, (b & 0x0F) << 12 | b1 << 6 | b2, (b & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = self.classes[code]
        first = np.zeros(len(at), dtype=bool)
        first[np.searchsorted(at, firsts)] = True
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        # the last white space before something else starts a pre-token, and a blank joins what follows
        after = np.flatnonzero(run[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True
        start[after[code[after - 1] == 32]] = False
        # contractions
        mark = np.flatnonzero((code == 0x27) & run & start)
        mark = mark[mark + 1 < len(at)]
        mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
        if len(mark):
            one, two = code[mark + 1], np.where(mark + 2 < len(at), code[np.minimum(mark + 2, len(at) - 1)], 0)
            joined = ~first[np.minimum(mark + 2, len(at) - 1)]
            single = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
            double = joined & ((((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
            size = np.where(single, 1, np.where(double, 2, 0))
            mark, size = mark[size > 0], size[size > 0]
            start[mark + 1] = False
            rest = mark + 1 + size
            rest = rest[rest < len(at)]
            start[rest[(kind[rest] == LETTER)]] = True
        return at[start]

    # tokens

    def tokens(self, data: np.ndarray, firsts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, and per pre-token its byte position and number of ids. ``data`` has eight spare bytes."""
        starts = self.split(data[:end], firsts)
        lengths = np.diff(np.append(starts, end))
        words = _words(data)
        h = _hashes(words, starts, lengths)
        slot = _slot(h, self.displace, self.n)
        hit = self.length_at[slot] == lengths
        vocabulary = _words(self.data)
        at, to, left, open_ = starts, self.start_at[slot], lengths, None
        while True:  # exact comparison, eight bytes a round
            mask = _MASK[np.minimum(left, 8)]
            same = (words[at] & mask) == (vocabulary[np.minimum(to, len(vocabulary) - 1)] & mask)
            if open_ is None:
                hit &= same
                longer = np.flatnonzero(hit & (left > 8))
                open_ = longer
            else:
                hit[open_[~same]] = False
                longer = np.flatnonzero(same & (left > 8))
                open_ = open_[longer]
            if not len(longer):
                break
            at, to, left = at[longer] + 8, to[longer] + 8, left[longer] - 8
        counts = np.ones(len(starts), dtype=np.int64)
        missed = np.flatnonzero(~hit)
        if not len(missed):
            return self.ids[slot], starts, counts
        # distinct by content: the hash finds the groups, then each member's bytes are compared with its group's
        view = memoryview(data)
        _, sample, group = np.unique(h[missed] ^ (lengths[missed].astype(np.uint64) << np.uint64(1)), return_index=True, return_inverse=True)
        sample = missed[sample]
        other = np.flatnonzero(~_equal(words, starts[missed], starts[sample][group], lengths[missed], lengths[sample][group]))
        group[other] = len(sample) + np.arange(len(other))
        sample = np.append(sample, missed[other])
        merged = [self.merge(bytes(view[s : s + n])) for s, n in zip(starts[sample].tolist(), lengths[sample].tolist(), strict=True)]
        sizes = np.array([len(m) for m in merged], dtype=np.int64)
        pool, begins = np.concatenate(merged), np.cumsum(sizes) - sizes
        counts[missed] = sizes[group]
        out = np.empty(int(counts.sum()), dtype=np.int32)
        place = np.cumsum(counts) - counts
        out[place[hit]] = self.ids[slot[hit]]
        many = counts[missed]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(place[missed], many) + inner] = pool[np.repeat(begins[group], many) + inner]
        return out, starts, counts

    def merge(self, token: bytes) -> np.ndarray:
        found = self.memory.get(token)
        if found is None:
            found = np.array(self._merged(token), dtype=np.int32)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[token] = found
        return found

    def _merged(self, token: bytes) -> list[int]:
        merges, single = self.merges, self.single
        part = [single[b] for b in token]
        n = len(part)
        heap = []
        for i in range(n - 1):
            new = merges.get(part[i] << 16 | part[i + 1])
            if new is not None:
                heap.append((new, i, part[i], part[i + 1]))
        if not heap:
            return part
        heapq.heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, get = heapq.heappop, heapq.heappush, merges.get
        while heap:
            new, i, left, right = pop(heap)
            j = following[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one of the two was merged meanwhile
            part[i], part[j] = new, -1
            k = following[j]
            following[i] = k
            if k < n:
                before[k] = i
                made = get(new << 16 | part[k])
                if made is not None:
                    push(heap, (made, i, new, part[k]))
            k = before[i]
            if k >= 0:
                made = get(part[k] << 16 | new)
                if made is not None:
                    push(heap, (made, k, part[k], new))
        return [p for p in part if p >= 0]

    # Arrow

    def chunks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts of a string column, about ``CHUNK`` bytes at a time: rows, bytes, where each text starts (and the
        last ends), ids, pre-token starts, ids per pre-token. Null and empty texts are left out."""
        column = column.cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        sizes = np.diff(offsets)
        row = 0
        while row < n:
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
            low, high = int(offsets[row]), int(offsets[upto])
            full = row + np.flatnonzero(sizes[row:upto])
            if len(full):
                data = np.concatenate([raw[low:high], np.zeros(8, dtype=np.uint8)])
                firsts = offsets[full] - low
                yield full, data, np.append(firsts, high - low), *self.tokens(data, firsts, high - low)
            row = upto

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of every text of a string column."""
        pieces, totals = [], np.zeros(len(column), dtype=np.int64)
        for rows, _, edges, ids, starts, counts in self.chunks(column):
            totals[rows] = np.add.reduceat(counts, np.searchsorted(starts, edges[:-1]))
            pieces.append(ids)
        values = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(totals)]).astype(np.int32)), pa.array(values, type=pa.int32()))


def _printable() -> dict[str, int]:
    """The printable alphabet of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}


def _slot(h: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    d = displace[(h >> np.uint64(44)).astype(np.int64) % len(displace)]
    mixed = (h ^ (d * _K1)) * _K2
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _perfect(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: per bucket, largest first, the first displacement that puts its keys into free slots."""
    assert len(np.unique(h)) == n
    buckets = (n + 3) // 4
    bucket = (h >> np.uint64(44)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    displace, taken, slots = np.zeros(buckets, dtype=np.uint64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    for b in np.argsort(-np.diff(edges), kind="stable"):
        keys = order[edges[b] : edges[b + 1]]
        if not len(keys):
            break
        base, tries = np.uint64(0), np.arange(32, dtype=np.uint64)
        while True:
            mixed = (h[keys][None, :] ^ ((tries + base) * _K1)[:, None]) * _K2
            place = ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
            free = ~taken[place].any(axis=1)
            if len(keys) > 1:
                ranked = np.sort(place, axis=1)
                free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            good = np.flatnonzero(free)
            if len(good):
                displace[b] = tries[good[0]] + base
                slots[keys] = place[good[0]]
                taken[place[good[0]]] = True
                break
            base += np.uint64(len(tries))
            tries = np.arange(min(4 * len(tries), 1 << 16), dtype=np.uint64)
    return displace, slots


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = FOLDER) -> Encoder:
    """One encoder per process and vocabulary."""
    if (name, folder) not in _LOADED:
        _LOADED[name, folder] = Encoder.load(name, folder)
    return _LOADED[name, folder]


def encoded(documents: DataFrame, identifier: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(identifier, ids): one row per document."""
    shared = documents.sparkSession.sparkContext.broadcast(encoder(name, folder))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), tool.encode(batch.column(1))], names=[identifier, "ids"])

    kind = dict(documents.dtypes)[identifier]
    return documents.select(identifier, text).mapInArrow(encode, f"`{identifier}` {kind}, ids array<int>")


def measured(documents: DataFrame, identifier: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(identifier, n): the number of tokens of each document, 0 for null and empty texts."""
    shared = documents.sparkSession.sparkContext.broadcast(encoder(name, folder))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            sizes = np.diff(tool.encode(batch.column(1)).offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[identifier, "n"])

    kind = dict(documents.dtypes)[identifier]
    return documents.select(identifier, text).mapInArrow(measure, f"`{identifier}` {kind}, n bigint")
