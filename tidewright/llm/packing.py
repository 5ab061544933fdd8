"""Filling containers of equal capacity with whole texts, by minimum bin slack on the histogram of sizes.

Sizes are integers up to the capacity, so a histogram of at most ``capacity`` rows says all the plan needs;
that is the only thing the driver gets. For each window the largest remaining size is taken and a subset-sum
over a bitset (bounded multiplicities in binary parts) finds the multiset of remaining sizes that comes closest
to the capacity; its counts are backtracked. The same filling is repeated as often as the histogram allows,
so every step uses up at least one size and the number of fillings is bounded by a small multiple of the
capacity, whatever the number of texts.

Texts are then numbered within their size (by hash buckets, so that a size held by a third of all texts is
spread over many tasks) and the number is looked up in the plan. Texts above the capacity are cut into pieces
of exactly the capacity and a rest. Texts without tokens take no space: one row with a null container. Rows
that repeat a text are texts of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm import bpe
from tidewright.session import cut_lineage

CAPACITY = 2048
#: Texts of one size that are numbered together, about.
TOGETHER = 20_000


def closest_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes, within ``counts``, whose sum is the largest not above ``room``."""
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in sorted(counts, reverse=True):
        most = min(counts[size], room // size) if size <= room else 0
        part = 1
        while most > 0:
            take = min(part, most)
            grown = sums | (sums << (take * size)) & mask
            if grown != sums:
                steps.append((sums, size, take))
                sums = grown
            most -= take
            part *= 2
        if sums >> room & 1:
            break
    left, found = sums.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> left & 1:
            found[size] = found.get(size, 0) + take
            left -= take * size
    return found


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (size, from, count per container, containers, first container): the texts of a size numbered
    from ``from`` on go, ``count`` at a time, into that many containers."""
    left = {size: n for size, n in histogram.items() if n > 0 and 0 < size <= capacity}
    used = dict.fromkeys(left, 0)
    segments, container = [], 0
    while left:
        largest = max(left)
        rest = {s: n - (s == largest) for s, n in left.items() if n - (s == largest) > 0}
        filling = closest_filling(rest, capacity - largest)
        filling[largest] = filling.get(largest, 0) + 1
        times = min(left[s] // k for s, k in filling.items())
        for size, k in filling.items():
            segments.append((size, used[size], k, times, container))
            used[size] += k * times
            left[size] -= k * times
            if not left[size]:
                del left[size]
        container += times
    return segments


def pieces(measured: DataFrame, identifier: str, capacity: int) -> DataFrame:
    """(identifier, piece, start, size): one row per text, or per piece where a text exceeds the capacity."""
    n, c = F.col("n"), F.lit(capacity).cast("bigint")
    last = F.greatest(F.ceil(n / c).cast("bigint") - 1, F.lit(0).cast("bigint"))
    cut = measured.select(identifier, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select(identifier, F.col("piece").cast("int").alias("piece"), (F.col("piece") * c).alias("start"), F.least(n - F.col("piece") * c, c).alias("size"))


def numbered(parts: DataFrame, identifier: str, histogram: dict[int, int], together: int = TOGETHER) -> DataFrame:
    """Adds number: the place of a row among the rows of its size, from 0, in an order that only depends on the rows. A size
    is numbered in as many parts as its count (``histogram``, a row per size) asks for."""
    sizes = parts.sparkSession.createDataFrame([(s, -(-n // together)) for s, n in histogram.items()], "size bigint, parts bigint")
    spread = parts.join(F.broadcast(sizes), "size").withColumn("bucket", F.pmod(F.xxhash64(identifier, "piece"), F.col("parts"))).drop("parts")
    counts = spread.groupBy("size", "bucket").agg(F.count("*").alias("held"))  # a row per `together` texts
    before = F.sum("held").over(Window.partitionBy("size").orderBy("bucket")) - F.col("held")
    within = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(identifier, "piece")) - 1
    return spread.withColumn("within", within).join(counts.withColumn("before", before), ["size", "bucket"]).withColumn("number", F.col("before") + F.col("within"))


def packed(documents: DataFrame, capacity: int = CAPACITY, identifier: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = bpe.FOLDER) -> DataFrame:
    """(identifier, piece, start, size, container): where each text, or piece of it, goes."""
    parts = cut_lineage(pieces(bpe.measured(documents, identifier, text, name, folder), identifier, capacity))
    histogram = {r["size"]: r["count"] for r in parts.where("size > 0").groupBy("size").count().collect()}  # at most `capacity` rows
    segments = sorted(plan(histogram, capacity))
    found = parts.sparkSession.sparkContext.broadcast(np.array(segments, dtype=np.int64).reshape(-1, 5))
    kind = dict(parts.dtypes)[identifier]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = found.value
        key = (table[:, 0] << 40) + table[:, 1]  # sorted: by size, then by first number
        for batch in batches:
            size, number = batch.column("size").to_numpy(), batch.column("number").to_numpy()
            row = table[np.searchsorted(key, (size << 40) + number, side="right") - 1]
            container = row[:, 4] + (number - row[:, 1]) // np.maximum(row[:, 2], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(container)], names=[identifier, "piece", "start", "size", "container"])

    schema = f"`{identifier}` {kind}, piece int, start bigint, size bigint, container bigint"
    full = numbered(parts.where("size > 0"), identifier, histogram).select(identifier, "piece", "start", "size", "number").mapInArrow(place, schema)
    return full.unionByName(parts.where("size = 0").withColumn("container", F.lit(None).cast("bigint")))


def containers(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, texts, used, unused) of :func:`packed` rows."""
    filled = assigned.where(F.col("container").isNotNull()).groupBy("container").agg(F.count("*").alias("texts"), F.sum("size").alias("used"))
    return filled.withColumn("unused", F.lit(capacity) - F.col("used"))
