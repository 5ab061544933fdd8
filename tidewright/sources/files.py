"""Tables, day archives and configuration from files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORY = "story_id string, title string, arxiv_id string, published_at timestamp, summary string, section string, score double, primary_link struct<url:string,link_type:string,source_id:string,tier:int,title:string>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, url, payload): whole files, named after their source."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("payload"))
    return files.select(F.regexp_extract("url", r"([^/]+?)(\.[^./]*)?$", 1).alias("source_id"), "url", "payload")


def day_archives(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Stories of the archived days from ``first`` to ``last``; days are directories ``digest_date=...``, so others are
    never opened."""
    days = spark.read.schema(f"{STORY}, digest_date date").option("basePath", folder).json(folder)
    return days.where(F.col("digest_date").between(first, last))


def configuration(path: str) -> dict:
    """A YAML or JSON configuration file, checked for repeated source ids. YAML needs its library."""
    import json

    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:  # an optional dependency
            raise RuntimeError("reading YAML needs PyYAML") from error
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    ids = [s.get("id") for s in (found or {}).get("sources", [])]
    repeated = {i for i in ids if ids.count(i) > 1}
    if repeated:
        raise ValueError(f"repeated source ids: {sorted(repeated)}")
    return found
