"""Inner join of two arrays on all coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ArraySchema, join_schema, require_joinable


def join(a: DataFrame, a_schema: ArraySchema, b: DataFrame, b_schema: ArraySchema, name: str = "joined") -> tuple[DataFrame, ArraySchema]:
    """Cells that both arrays have: a's dimensions and attributes, then b's.  Spark picks the strategy: a broadcast if a side is known to be small,
    else a merge of both, for which arrays partitioned alike by their dimensions need no exchange."""
    require_joinable(a_schema, b_schema)
    schema = join_schema(a_schema, b_schema, name)
    added = schema.attribute_names[len(a_schema.attributes) :]
    right = b.select(*[F.col(n).alias(m) for n, m in zip(b_schema.dim_names, a_schema.dim_names, strict=True)], *[F.col(n).alias(m) for n, m in zip(b_schema.attribute_names, added, strict=True)])
    left = a.select(*a_schema.columns)
    return left.join(right, a_schema.dim_names, "inner").select(*schema.columns), schema
