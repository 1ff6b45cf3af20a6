"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAMAGED = "�"


def unmapped_categories(benefits: DataFrame, match_map: DataFrame, category: str = "category") -> DataFrame:
    """Benefit categories that no spending category matches, how many benefits they have, and whether the name is damaged."""
    lost = benefits.join(F.broadcast(match_map.select(category).distinct()), category, "left_anti")
    rows = lost.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(category, "n", F.contains(F.col(category).cast("string"), F.lit(DAMAGED)).alias("damaged"))
