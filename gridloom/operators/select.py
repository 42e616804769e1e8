"""Range selection, attribute filters, aggregates and nearest neighbours: narrow plans over a live view."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from ..functions.curves import hilbert_axes
from ..functions.ids import tile_id, with_order
from ..schema import TYPES, ArraySchema, SchemaError


def in_range(schema: ArraySchema, bounds: Sequence[float]) -> Column:
    """Closed bounds lo0, hi0, lo1, hi1, ... of a hyper-rectangle; literals in the dimensions' type, so that they reach the scan."""
    if len(bounds) != 2 * len(schema.dims):
        raise SchemaError("a range has two bounds for each dimension")
    test = F.lit(True)
    for d, lo, hi in zip(schema.dims, bounds[::2], bounds[1::2], strict=True):
        if lo > hi:
            raise SchemaError(f"the range of {d.name} ends before it begins")
        if schema.dim_type in ("int", "int64_t"):  # whole bounds within: a fractional literal would put a cast on the column
            lo, hi = math.ceil(lo), math.floor(hi)
        kind = TYPES[schema.dim_type]
        test &= F.col(d.name).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)) if lo <= hi else F.lit(False)
    return test


def in_tile(schema: ArraySchema, tile_id: int) -> Column:
    """Cells of a regular tile, as a range of coordinates."""
    sizes = schema.tiles_per_dim
    if schema.order == "hilbert":
        at = hilbert_axes(np.array([tile_id]), len(sizes), schema.hilbert_bits)[0].tolist()
    else:
        at, rest = [], tile_id
        for n in sizes[::-1] if schema.order == "column-major" else sizes:
            rest, place = divmod(rest, n)
            at.append(place)
        at = at[::-1] if schema.order == "column-major" else at
    test, kind = F.lit(tile_id >= 0 and all(a < n for a, n in zip(at, sizes, strict=True)) and tile_id < 1 << 63), TYPES[schema.dim_type]
    for d, e, a in zip(schema.dims, schema.extents, at, strict=True):
        lo, hi = d.lo + a * e, d.lo + (a + 1) * e
        if schema.dim_type in ("int", "int64_t"):
            lo, hi = math.ceil(lo), math.ceil(hi)
        test &= (F.col(d.name) >= F.lit(lo).cast(kind)) & (F.col(d.name) < F.lit(hi).cast(kind))
    return test


def subarray(df: DataFrame, schema: ArraySchema, bounds: Sequence[float]) -> DataFrame:
    return df.where(in_range(schema, bounds))


def filter_cells(df: DataFrame, schema: ArraySchema, expression: str) -> DataFrame:
    """Cells for which the expression over the attributes isn't zero."""
    return df.where(expressions.parse(expression, schema).truth)


def filter_predicate(df: DataFrame, schema: ArraySchema, attribute: str, op: str, operand: float) -> DataFrame:
    return df.where(expressions.predicate(attribute, op, operand, schema))


def filter_preset(df: DataFrame, schema: ArraySchema, attribute: str) -> DataFrame:
    if attribute not in schema.attribute_names:
        raise SchemaError(f"{attribute} is no attribute")
    return df.where(expressions.preset(attribute))


def aggregate_max(df: DataFrame, schema: ArraySchema, attribute: str) -> DataFrame:
    if attribute not in schema.attribute_names:
        raise SchemaError(f"{attribute} is no attribute")
    return df.agg(F.max(attribute).alias(f"max_{attribute}"))


def squared_distance(schema: ArraySchema, point: Sequence[float]) -> Column:
    if len(point) != len(schema.dims):
        raise SchemaError("a point has a coordinate for each dimension")
    parts = [F.pow(F.col(d.name).cast("double") - F.lit(float(q)), 2) for d, q in zip(schema.dims, point, strict=True)]
    return sum(parts[1:], parts[0])


def nearest(df: DataFrame, schema: ArraySchema, point: Sequence[float], k: int) -> DataFrame:
    """The k cells nearest to a point (squared Euclidean distance in ``dist2``), ties in global order.

    Each task keeps its k nearest and what is as near as the last of them; a merge does so again, and only those rows get an order id."""
    if k < 1:
        raise SchemaError("k is one at least")
    measured = df.withColumn("dist2", squared_distance(schema, point))
    near = measured.withColumn("_rank", F.rank().over(Window.orderBy("dist2"))).where(F.col("_rank") <= k).drop("_rank")
    ordered, keys = with_order(near, schema)
    return ordered.orderBy("dist2", *keys).limit(k).select(*schema.columns, "dist2")


def nearest_vectors(df: DataFrame, key: str, vector: str, point: Sequence[float], k: int) -> DataFrame:
    """k nearest rows by a many-dimensional array column, ties by key."""
    target = F.array(*[F.lit(float(x)) for x in point])
    dist2 = F.aggregate(F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return df.select(key, dist2.alias("dist2")).orderBy("dist2", key).limit(k)


def tile_distance(index: DataFrame, schema: ArraySchema, point: Sequence[float]) -> DataFrame:
    """The tile index with ``mindist2``: the squared distance from the point to each tile's bounding box."""
    gaps = [F.greatest(F.col(f"{d.name}_min").cast("double") - q, F.lit(float(q)) - F.col(f"{d.name}_max"), F.lit(0.0)) for d, q in zip(schema.dims, point, strict=True)]
    return index.withColumn("mindist2", sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def overlapping_tiles(index: DataFrame, schema: ArraySchema, bounds: Sequence[float]) -> DataFrame:
    """Tiles whose bounding box meets the range, and whether it lies within it (``full``)."""
    meets, full = F.lit(True), F.lit(True)
    for d, lo, hi in zip(schema.dims, bounds[::2], bounds[1::2], strict=True):
        low, high = F.col(f"{d.name}_min"), F.col(f"{d.name}_max")
        meets &= (low <= hi) & (high >= lo)
        full &= (low >= lo) & (high <= hi)
    return index.where(meets).withColumn("full", full)


def with_tile_id(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """Regular arrays: cells with their ``tile_id``."""
    if not schema.regular:
        raise SchemaError("irregular tiles come from the cells' ranks: use irregular_tiles")
    return df.withColumn("tile_id", tile_id(schema))
