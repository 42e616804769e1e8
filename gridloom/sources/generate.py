"""Synthetic cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(spark: SparkSession, cells: int, columns: int = 4, lo: int = 0, hi: int = 1_000_000, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows of uniform integers in [lo, hi]: c0, c1, ..."""
    rows = spark.range(0, cells, 1, partitions) if partitions else spark.range(cells)
    return rows.select(*[(F.floor(F.rand(seed + i) * (hi - lo + 1)) + lo).cast("long").alias(f"c{i}") for i in range(columns)])


def skewed(spark: SparkSession, cells: int, columns: int = 4, lo: int = 0, hi: int = 1_000_000, seed: int = 0, power: float = 3.0) -> DataFrame:
    """As uniform, but crowded towards lo: a uniform number to a power."""
    return spark.range(cells).select(*[(F.floor(F.pow(F.rand(seed + i), F.lit(power)) * (hi - lo + 1)) + lo).cast("long").alias(f"c{i}") for i in range(columns)])
