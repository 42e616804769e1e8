"""Tile ids, cell ids and the global order of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ArraySchema
from .curves import hilbert, hilbert_expression

ID = "_order_id"


def _at(schema: ArraySchema, cell: str | None) -> list[Column]:
    """The coordinates: columns, or the fields of a struct column."""
    return [F.col(f"{cell}.{n}" if cell else n) for n in schema.dim_names]


def tile_coordinates(schema: ArraySchema, cell: str | None = None) -> list[Column]:
    """Number of the tile in each dimension, from the domain's lower bound on."""
    return [F.floor((c - F.lit(d.lo)) / F.lit(e)).cast("long") for c, d, e in zip(_at(schema, cell), schema.dims, schema.extents, strict=True)]


def _strided(coordinates: list[Column], sizes: list[int]) -> Column:
    out, stride = None, 1
    for c, n in zip(coordinates, sizes, strict=True):
        out, stride = (c * stride if out is None else out + c * stride), stride * n
    return out


def tile_id_row_major(schema: ArraySchema, cell: str | None = None) -> Column:
    """Tiles numbered with the first dimension running fastest."""
    return _strided(tile_coordinates(schema, cell), schema.tiles_per_dim)


def tile_id_column_major(schema: ArraySchema, cell: str | None = None) -> Column:
    """Tiles numbered with the last dimension running fastest."""
    return _strided(tile_coordinates(schema, cell)[::-1], schema.tiles_per_dim[::-1])


def tile_id_hilbert(schema: ArraySchema, cell: str | None = None, *, in_jvm: bool = False) -> Column:
    return (hilbert_expression if in_jvm else hilbert)(tile_coordinates(schema, cell), schema.hilbert_bits)


def cell_id_hilbert(schema: ArraySchema, cell: str | None = None, *, in_jvm: bool = False) -> Column:
    cells = [F.floor(c - F.lit(d.lo)).cast("long") for c, d in zip(_at(schema, cell), schema.dims, strict=True)]
    return (hilbert_expression if in_jvm else hilbert)(cells, schema.hilbert_bits)


def tile_id(schema: ArraySchema, cell: str | None = None) -> Column:
    """The id by which regular tiles are ordered."""
    return {"hilbert": tile_id_hilbert, "column-major": tile_id_column_major}.get(schema.order, tile_id_row_major)(schema, cell)


def with_order(df: DataFrame, schema: ArraySchema) -> tuple[DataFrame, list[Column]]:
    """df with an id column where the order needs one, and the columns to sort by."""
    dims = [F.col(n) for n in schema.dim_names]
    if schema.regular:
        return df.withColumn(ID, tile_id(schema)), [F.col(ID), *dims]
    if schema.order == "hilbert":
        return df.withColumn(ID, cell_id_hilbert(schema)), [F.col(ID), *dims]
    return df, dims[::-1] if schema.order == "column-major" else dims


def precedes(schema: ArraySchema, a: str, b: str) -> Column:
    """Whether cell (struct column) a comes before b in global order: by tile, by place on the curve, or by coordinates."""
    return F.struct(*_order_of(schema, a)) < F.struct(*_order_of(schema, b))


def _order_of(schema: ArraySchema, cell: str) -> list[Column]:
    dims = _at(schema, cell)
    if schema.regular:
        return [tile_id(schema, cell), *dims]
    if schema.order == "hilbert":
        return [cell_id_hilbert(schema, cell), *dims]
    return dims[::-1] if schema.order == "column-major" else dims


def succeeds(schema: ArraySchema, a: str, b: str) -> Column:
    return precedes(schema, b, a)


def text_hash(text: Column) -> Column:
    """Knuth's 32-bit shift-and-xor string hash (The Art of Computer Programming, vol. 3), as an unsigned value in a long."""
    mask, codes = F.lit(0xFFFFFFFF), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    turned = lambda h: F.shiftleft(h, 5).bitwiseAND(mask).bitwiseXOR(F.shiftright(h, 27))
    return F.aggregate(codes, F.length(text).cast("long"), lambda h, c: turned(h).bitwiseXOR(c))
