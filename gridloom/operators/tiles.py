"""Physical order: global ranks, irregular tiles, tile index, partitioned loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ID, tile_id, with_order
from ..plans.storage import cut
from ..schema import ArraySchema

#: Cells of a partition are numbered within 33 bits.
_WITHIN = 33


def global_rank(df: DataFrame, schema: ArraySchema, partitions: int | None = None) -> DataFrame:
    """df with ``rank``: each cell's number (from 0) in global order.

    Range partitioning on the order, a count for each partition, and numbers within partitions: no task sees all rows."""
    ordered, keys = with_order(df, schema)
    spread = ordered.repartitionByRange(partitions, *keys) if partitions else ordered.repartitionByRange(*keys)
    placed = cut(spread.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop(ID))
    part = F.shiftright("_at", _WITHIN)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return numbered.withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << _WITHIN) - 1))).drop("_part", "_base", "_at")


def irregular_tiles(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """Cells with ``tile_id``: every ``capacity`` cells in global order make a tile."""
    return global_rank(df, schema).withColumn("tile_id", F.floor(F.col("rank") / schema.capacity).cast("long")).drop("rank")


def tiled(df: DataFrame, schema: ArraySchema) -> DataFrame:
    return df.withColumn("tile_id", tile_id(schema)) if schema.regular else irregular_tiles(df, schema)


def tile_index(cells: DataFrame, schema: ArraySchema) -> DataFrame:
    """Number of cells and bounding box of each tile, from cells with ``tile_id``."""
    bounds = [f(n).alias(f"{n}_{x}") for n in schema.dim_names for x, f in (("min", F.min), ("max", F.max))]
    return cells.groupBy("tile_id").agg(F.count("*").alias("cells"), *bounds)


def bounding_cells(cells: DataFrame, schema: ArraySchema) -> DataFrame:
    """The first and last cell of each tile in global order (structs)."""
    ordered, keys = with_order(cells, schema)
    key, cell = F.struct(*keys), F.struct(*schema.dim_names)
    return ordered.groupBy("tile_id").agg(F.min_by(cell, key).alias("first"), F.max_by(cell, key).alias("last"))


def hash_partitioned(df: DataFrame, schema: ArraySchema, partitions: int) -> DataFrame:
    """Cells dealt out by a hash of their coordinates: arrays dealt alike join without another exchange."""
    return df.repartition(partitions, *schema.dim_names)


def range_partitioned(df: DataFrame, schema: ArraySchema, partitions: int) -> DataFrame:
    """Cells in global order over partitions whose bounds Spark samples."""
    ordered, keys = with_order(df, schema)
    return ordered.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select(*df.columns)


def partition_bounds(df: DataFrame, schema: ArraySchema, partitions: int) -> DataFrame:
    """Upper bounds of the order's first key that cut the cells into about equal parts: ``part``, ``bound``; the last part has none."""
    ordered, keys = with_order(df, schema)
    shares = [i / partitions for i in range(1, partitions)]
    found = ordered.agg(F.percentile_approx(keys[0], F.array(*[F.lit(s) for s in shares]), 10_000).alias("b"))
    return found.select(F.posexplode("b").alias("part", "bound"))


def receiver(key, bounds: list):
    """The partition whose bound is the first at or above the key."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(key <= F.lit(bounds[i]), i).otherwise(out)
    return out


def sample_cells(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows: those with the smallest random numbers."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(k).drop("_r")
