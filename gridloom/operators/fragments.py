"""Versions of cells: the live view over batches, and their consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETED, SEQ, ArraySchema


def latest(batches: DataFrame, schema: ArraySchema) -> DataFrame:
    """The newest version of each cell, deletions included."""
    newest = Window.partitionBy(*schema.dim_names).orderBy(F.desc(SEQ))
    return batches.withColumn("_v", F.row_number().over(newest)).where("_v = 1").drop("_v")


def live_view(batches: DataFrame, schema: ArraySchema, *, single: bool = False) -> DataFrame:
    """The cells that are there: newest versions that aren't deletions.  A single batch has one version of each cell, so it needs no shuffle."""
    found = batches if single else latest(batches, schema)
    return found.where(~F.col(DELETED)).select(*schema.columns)


def merge(batches: DataFrame, schema: ArraySchema, *, purge: bool) -> DataFrame:
    """Batches as one.  Deletions go only if the oldest batch is among them; else they still hide older cells."""
    found = latest(batches, schema)
    return found.where(~F.col(DELETED)) if purge else found


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
