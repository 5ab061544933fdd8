"""The incremental operators as Structured Streaming."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.functions import url
from tidewright.operators.state import merged


def sightings(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each address once: its first sighting, forgotten when the watermark has passed it."""
    return stream.withColumn("url", url.canonical(F.col("url"))).withWatermark("seen", late).dropDuplicatesWithinWatermark(["url"])


def per_window(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Observations and sources per window and kind, closed after the watermark."""
    return stream.withWatermark("seen", late).groupBy(F.window("seen", width), "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("source_id").alias("sources"))


class Commits:
    """The log of a state folder: one small file per committed generation, the highest number is the state. Files appear by
    renaming, so a reader sees a whole one or none; what fails is an error, never taken for an empty state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(folder).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(f"{folder}/_commits"))

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.folder}/_commits"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def last(self) -> dict | None:
        """What was committed last: number, generation, query and batch."""
        known = self.numbers()
        if not known:
            return None
        stream = self.fs.open(self._path(f"{self.folder}/_commits/{known[-1]:012d}.json"))
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def add(self, generation: str, query: str, batch: int) -> None:
        number = (self.numbers() or [0])[-1] + 1
        draft, name = self._path(f"{self.folder}/_commits/.{generation}"), self._path(f"{self.folder}/_commits/{number:012d}.json")
        out = self.fs.create(draft, True)
        out.writeBytes(json.dumps({"number": number, "generation": generation, "query": query, "batch": batch}))
        out.close()
        if not self.fs.rename(draft, name):
            raise OSError(f"another writer committed {number} in {self.folder}")

    def drop(self, generation: str) -> None:
        self.fs.delete(self._path(f"{self.folder}/{generation}"), True)


STATE = "url string, content_hash string, title string, first_seen timestamp, last_seen timestamp"


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    """The committed state; empty before the first batch."""
    last = Commits(spark, folder).last()
    return spark.read.schema(STATE).parquet(f"{folder}/{last['generation']}") if last else spark.createDataFrame([], STATE)


def upsert(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of items in ``folder`` batch by batch. A batch that this checkpoint has committed before is not applied again; a new
    checkpoint goes on from the state that is there. The generation before the last is removed."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, folder)
        last = commits.last()
        if last and last["query"] == checkpoint and last["batch"] >= number:
            return
        rows = batch.withColumn("url", url.canonical(F.col("url"))).groupBy("url").agg(F.max(F.struct("seen", "content_hash", "title")).alias("r")).select("url", "r.content_hash", "r.title", "r.seen")
        generation = f"generation-{uuid.uuid4().hex}"
        merged(current_state(spark, folder), rows, "url", "content_hash", "seen").write.parquet(f"{folder}/{generation}")
        commits.add(generation, checkpoint, number)
        if last:
            commits.drop(last["generation"])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
