"""A stream of label maps: an addition, as the engine's batch operators have no streaming counterpart to match.

Rows are decoded as they arrive, without state but for the content hashes that tell repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_tiles(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows of vec_id, embedding and arrived (a timestamp) whose content has not come within `delay`."""
    keyed = stream.withColumn("content", F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256))
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["content"])


def label_counts(tiles: DataFrame, low: float = -0.08, high: float = 0.08) -> DataFrame:
    """Pixels of each label of every tile, by expressions over its array."""

    def count(test):
        return F.size(F.filter("embedding", test)).cast("long")

    return tiles.select("vec_id", count(lambda v: v < low).alias("dark"), count(lambda v: (v >= low) & (v < high)).alias("middle"), count(lambda v: v >= high).alias("light"))
