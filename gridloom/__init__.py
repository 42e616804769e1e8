"""Sparse multi-dimensional arrays as Spark DataFrames."""

from .engine import Engine
from .schema import ArraySchema, Dimension, SchemaError

__all__ = ["ArraySchema", "Dimension", "Engine", "SchemaError"]
