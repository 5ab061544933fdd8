"""Documents, archives and state written by Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_archive(stories: DataFrame, folder: str) -> None:
    """Days as directories of JSON lines; writing a day again replaces that day only."""
    spread = stories.repartition("digest_date", F.pmod(F.xxhash64("story_id"), F.lit(8)))  # a large day keeps several writers
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest_date").json(folder)


def state(items: DataFrame, folder: str, files: int | None = None) -> None:
    """The state of items by month of first sight, which retention and window queries prune by. Writing some months again replaces
    those only."""
    out = items.withColumn("month", F.date_format("first_seen", "yyyy-MM"))
    out = out.repartition(files, "month", F.pmod(F.xxhash64("url"), F.lit(16))) if files else out
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)


def index_entry(index: DataFrame, entry: DataFrame, key: list[str]) -> DataFrame:
    """An index with an entry replaced or added."""
    return index.join(entry.select(*key).distinct(), key, "left_anti").unionByName(entry)


def newest(rows: DataFrame, group: str, when: str, last: str, n: int) -> DataFrame:
    """The newest ``n`` rows per group, for pruning pages, backups and snapshots; of equally new ones those with the smaller ``last``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.col(when).desc_nulls_last(), F.col(last).asc()))).where(F.col("_n") <= n).drop("_n")


def prometheus(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Metric lines in the text format of Prometheus, one row each."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    return metrics.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
