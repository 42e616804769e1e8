"""Arrays of a workspace: schemas, fragments and the consolidation policy's book-keeping, as JSON beside the data.

An array's state (schema and manifest together) is a numbered file; the highest number counts.  A change is a new file, so a crash leaves the old
state or the new one, never a part of either."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..schema import ArraySchema, SchemaError
from .storage import Store


@dataclass
class Fragment:
    """An immutable batch: updates ``lo`` to ``hi``, merged ``level`` times."""

    lo: int
    hi: int
    level: int = 0
    tombstones: bool = False
    #: Buckets of a hash of the coordinates, each a sorted file; 0: files by ranges of the global order.
    buckets: int = 0

    @property
    def name(self) -> str:
        return f"{self.lo}_{self.hi}"


@dataclass
class Manifest:
    fragments: list[Fragment] = field(default_factory=list)
    next_seq: int = 0
    step: int = 3
    partitioning: dict | None = None
    last_batch: int = -1

    @classmethod
    def from_dict(cls, raw: dict) -> Manifest:
        return cls(**raw | {"fragments": [Fragment(**f) for f in raw["fragments"]]})


def due(fragments: list[Fragment], step: int) -> tuple[int, Fragment] | None:
    """What the lazy policy merges next: (how many of the last fragments, the result).

    With step 1 all of them at once; else ``step`` of one level become one of the next level."""
    if step == 1:
        return (len(fragments), Fragment(fragments[0].lo, fragments[-1].hi, 0)) if len(fragments) > 1 else None
    last = fragments[-step:]
    if step > 1 and len(last) == step and len({f.level for f in last}) == 1:
        return step, Fragment(last[0].lo, last[-1].hi, last[0].level + 1)
    return None


_STATE = re.compile(r"state-(\d+)\.json")


class Catalog:
    def __init__(self, spark: SparkSession, workspace: str):
        self.store = Store(spark, workspace)

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(m[1]) for f in self.store.files(name) if (m := _STATE.fullmatch(f)))

    def _state(self, name: str) -> dict:
        if not (numbers := self._numbers(name)):
            raise SchemaError(f"array {name} isn't defined")
        return json.loads(self.store.read(name, f"state-{numbers[-1]}.json"))

    def defined(self, name: str) -> bool:
        return bool(self._numbers(name))

    def loaded(self, name: str) -> bool:
        return self.defined(name) and bool(self.manifest(name).fragments)

    def names(self) -> list[str]:
        return [n for n in self.store.folders() if self.defined(n)]

    def define(self, schema: ArraySchema, step: int = 3, manifest: Manifest | None = None) -> None:
        if self.defined(schema.name):
            raise SchemaError(f"array {schema.name} is defined already")
        self._add(schema, manifest or Manifest(step=step), [])

    def _add(self, schema: ArraySchema, manifest: Manifest, numbers: list[int]) -> None:
        number = numbers[-1] + 1 if numbers else 0
        text = json.dumps({"schema": json.loads(schema.to_json()), "manifest": asdict(manifest)})
        if not self.store.create(text, schema.name, f"state-{number}.json"):
            raise SchemaError(f"array {schema.name} was changed by another session meanwhile")
        for old in numbers[:-1]:  # the state before stays, for readers that have just listed it
            self.store.delete(schema.name, f"state-{old}.json")

    def schema(self, name: str) -> ArraySchema:
        return ArraySchema.from_json(json.dumps(self._state(name)["schema"]))

    def manifest(self, name: str) -> Manifest:
        return Manifest.from_dict(self._state(name)["manifest"])

    def save(self, name: str, manifest: Manifest | None = None, schema: ArraySchema | None = None) -> None:
        """A new state with another manifest, schema, or both at once."""
        self._add(schema or self.schema(name), manifest or self.manifest(name), self._numbers(name))

    def fragment_path(self, name: str, fragment: Fragment) -> str:
        return self.store.path(name, "fragments", fragment.name)

    def clear(self, name: str) -> None:
        """Drops the data, keeps the schema."""
        step = self.manifest(name).step
        self.save(name, Manifest(step=step))
        self.store.delete(name, "fragments")

    def delete(self, name: str) -> None:
        self.schema(name)
        self.store.delete(name)
