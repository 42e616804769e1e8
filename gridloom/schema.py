"""Array schemas: typed dimensions with closed domains, typed attributes, cell or tile order, tiling."""

from __future__ import annotations

import dataclasses
import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import types as T

# Type and order names, and the default number of cells in a tile.
TYPES = {"char": T.StringType(), "int": T.IntegerType(), "int64_t": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}
ORDERS = ("column-major", "hilbert", "row-major", "none")
DEFAULT_CAPACITY = 10000

#: Columns that fragments carry beside dimensions and attributes.
SEQ, DELETED = "_seq", "_deleted"
_NAME = re.compile(r"[A-Za-z0-9_]+")


class SchemaError(ValueError):
    """A schema, or the use of one, that breaks the data model's rules."""


@dataclass(frozen=True)
class Dimension:
    name: str
    lo: float
    hi: float

    @property
    def length(self) -> float:
        return self.hi - self.lo + 1


@dataclass(frozen=True)
class ArraySchema:
    """dims share ``dim_type``; with ``extents`` the tiles are regular and ``order`` is the tiles', else it is the cells'."""

    name: str
    dims: tuple[Dimension, ...]
    attributes: tuple[tuple[str, str], ...]
    dim_type: str = "int64_t"
    order: str = "row-major"
    extents: tuple[float, ...] | None = None
    capacity: int = DEFAULT_CAPACITY

    def __post_init__(self):
        object.__setattr__(self, "dims", tuple(d if isinstance(d, Dimension) else Dimension(*d) for d in self.dims))
        object.__setattr__(self, "attributes", tuple((n, t) for n, t in self.attributes))
        object.__setattr__(self, "extents", tuple(self.extents) if self.extents else None)
        names = [*self.dim_names, *self.attribute_names]
        for name in (self.name, *names):
            if not _NAME.fullmatch(name):
                raise SchemaError(f"names hold letters, digits and underscores only: {name!r}")
        if not self.dims or not self.attributes:
            raise SchemaError("an array needs a dimension and an attribute")
        if len({n.lower() for n in names}) != len(names):
            raise SchemaError("dimension and attribute names must differ from each other")
        if {SEQ, DELETED} & set(names):
            raise SchemaError(f"{SEQ} and {DELETED} are taken")
        if self.dim_type not in TYPES or self.dim_type == "char":
            raise SchemaError(f"dimensions can't be {self.dim_type}")
        if bad := [t for _, t in self.attributes if t not in TYPES]:
            raise SchemaError(f"unknown types: {bad}")
        if any(d.lo > d.hi for d in self.dims):
            raise SchemaError("a domain's lower bound is above its upper one")
        if self.order not in ORDERS:
            raise SchemaError(f"orders are {', '.join(ORDERS)}")
        if self.capacity < 1:
            raise SchemaError("the capacity is one cell at least")
        if self.extents is not None:
            if len(self.extents) != len(self.dims):
                raise SchemaError("there is a tile extent for each dimension, or none")
            if any(not 0 < e <= d.length for e, d in zip(self.extents, self.dims, strict=True)):
                raise SchemaError("a tile extent is above zero and within its domain")
        if self.order == "hilbert" and self.hilbert_bits * len(self.dims) > 63:
            raise SchemaError("a Hilbert index of these domains has more than 63 bits")

    @property
    def dim_names(self) -> list[str]:
        return [d.name for d in self.dims]

    @property
    def attribute_names(self) -> list[str]:
        return [n for n, _ in self.attributes]

    @property
    def columns(self) -> list[str]:
        """Dimensions, then attributes: a cell's order in CSV."""
        return [*self.dim_names, *self.attribute_names]

    @property
    def regular(self) -> bool:
        return self.extents is not None

    @property
    def tiles_per_dim(self) -> list[int]:
        return [math.ceil(d.length / e) for d, e in zip(self.dims, self.extents or (), strict=True)]

    @property
    def hilbert_bits(self) -> int:
        """Bits of a dimension: of tile coordinates with regular tiles, of cell coordinates otherwise."""
        longest = max(self.tiles_per_dim) if self.regular else math.ceil(max(d.length for d in self.dims))
        return max(1, math.ceil(math.log2(longest)))

    def struct(self, *, internal: bool = False) -> T.StructType:
        fields = [T.StructField(n, TYPES[self.dim_type], False) for n in self.dim_names]
        fields += [T.StructField(n, TYPES[t], True) for n, t in self.attributes]
        if internal:
            fields += [T.StructField(SEQ, T.IntegerType(), False), T.StructField(DELETED, T.BooleanType(), False)]
        return T.StructType(fields)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ArraySchema:
        raw = json.loads(text)
        return cls(**raw | {"dims": tuple(Dimension(**d) for d in raw["dims"])})

    def clone(self, name: str, **changes) -> ArraySchema:
        """The same schema under another name, with another order, capacity or tiling if given."""
        return dataclasses.replace(self, name=name, **changes)

    def __str__(self) -> str:
        dims = ", ".join(f"{d.name} [{d.lo}, {d.hi}]" for d in self.dims)
        attributes = ", ".join(f"{n} {t}" for n, t in self.attributes)
        tiles = f"regular tiles {list(self.extents)}" if self.regular else f"irregular tiles of {self.capacity} cells"
        return f"{self.name}({dims} {self.dim_type}; {attributes}; {self.order}, {tiles})"


def require_joinable(a: ArraySchema, b: ArraySchema) -> None:
    """The first difference that keeps two arrays from being joined."""
    checks = [
        (a.regular == b.regular, "Tile type mismatch."),
        (len(a.dims) == len(b.dims), "Dimension number mismatch."),
        (a.dim_type == b.dim_type, "Dimension type mismatch."),
        ([(d.lo, d.hi) for d in a.dims] == [(d.lo, d.hi) for d in b.dims], "Domain mismatch."),
        (a.order == b.order, "Order mismatch."),
        (a.extents == b.extents, "Tile extent mismatch."),
    ]
    for same, text in checks:
        if not same:
            raise SchemaError(text)


def join_schema(a: ArraySchema, b: ArraySchema, name: str) -> ArraySchema:
    """a's attributes, then b's; those of b that a has too get ``_2``."""
    taken, attributes = {*a.columns}, list(a.attributes)
    for n, t in b.attributes:
        new = f"{n}_2" if n in taken else n
        taken.add(new)
        attributes.append((new, t))
    return a.clone(name, attributes=tuple(attributes))
