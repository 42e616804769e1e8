"""Cells as comma-separated lines: coordinates, then attributes; no header or quotes; ``#`` starts a comment, ``$`` is a null."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import with_order
from ..schema import DELETED, ArraySchema


def in_domain(schema: ArraySchema) -> Column:
    test = F.lit(True)
    for d in schema.dims:
        test &= F.col(d.name).isNotNull() & F.col(d.name).between(F.lit(d.lo), F.lit(d.hi))
    return test


def checked(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """df, failing at the first cell outside the domain or with a char of more than one character."""
    good = in_domain(schema)
    for name, kind in schema.attributes:
        if kind == "char":
            good &= F.col(name).isNull() | (F.length(name) == 1)
    text = F.concat(F.lit("no cell of this array: "), F.to_json(F.struct(*schema.columns)))
    first = schema.dim_names[0]
    return df.withColumn(first, F.when(good, F.col(first)).otherwise(F.raise_error(text).cast(df.schema[first].dataType)))


def with_deletions(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """A cell whose attributes are all null deletes, and one that a column ``_deleted`` marks; other nulls are values."""
    gone = F.lit(True)
    for name in schema.attribute_names:
        gone &= F.col(name).isNull()
    return df.withColumn(DELETED, gone | F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in df.columns else gone)


def read_csv(spark: SparkSession, path: str | list[str], schema: ArraySchema) -> DataFrame:
    """Cells of CSV files with ``_deleted``, and with the places that tell which of several lines with equal coordinates counts: the last one, in the last
    of the paths, in the last file of a folder by name."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.struct()])
    parts = []
    for i, one in enumerate([path] if isinstance(path, str) else path):
        lines = spark.read.csv(one, schema=nullable, comment="#", nullValue="$", mode="FAILFAST", enforceSchema=True)
        place = F.struct(F.lit(i).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        parts.append(lines.select(*schema.columns, place.alias(PLACE)))
    return with_deletions(checked(reduce(DataFrame.unionByName, parts), schema), schema)


#: Where a line was read: of a batch's rows with equal coordinates the last one by this column counts.
PLACE = "_place"


def in_reading_order(df: DataFrame) -> DataFrame:
    """df with places in the order in which Spark reads it."""
    return df.withColumn(PLACE, F.monotonically_increasing_id())


def short_format(df: DataFrame, schema: ArraySchema) -> DataFrame:
    """Numbers of type float and double as C's ``%g`` writes them (6 digits), for compatibility."""

    @F.pandas_udf("string")
    def short(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:g}")

    real = [f.name for f in schema.struct() if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: short(F.col(n).cast("double")) for n in real})


def write_csv(df: DataFrame, path: str, schema: ArraySchema, *, short: bool = False, one_file: bool = False) -> None:
    """Cells in global order, as a folder of files whose names follow the order (or one file, written by one task)."""
    ordered, keys = with_order(df, schema)
    ordered = ordered.orderBy(*keys).select(*schema.columns)
    ordered = short_format(ordered, schema) if short else ordered
    (ordered.coalesce(1) if one_file else ordered).write.mode("errorifexists").csv(path, header=False, nullValue="$", emptyValue="")
