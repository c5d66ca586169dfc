"""Merging the layers, and when each of them counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings


def merge(semantic: DataFrame, fuzzy: DataFrame, limit: int, s: Settings = SETTINGS) -> DataFrame:
    """Hits of either layer, once per document with the better score, the best 2 * limit."""
    columns = [c for c in fuzzy.columns if c != "score"]
    both = fuzzy.unionByName(semantic.select(*fuzzy.columns))
    # a document's columns are the same in both layers, so any of its rows will do
    best = both.groupBy("rowid").agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in columns if c != "rowid"])
    return best.orderBy(F.desc("score"), "rowid").limit(limit * s.merged_factor)


def gated(semantic: DataFrame, coverage: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Semantic hits if the one-row ``coverage`` reaches the gate, none otherwise."""
    gate = coverage.where(F.col("coverage") >= s.ready_coverage).select(F.lit(True).alias("open"))
    return semantic.join(F.broadcast(gate)).drop("open")
