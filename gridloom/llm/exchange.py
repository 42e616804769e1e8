"""Packed exchange of (64-bit value, owner) pairs by value.

Pairs travel as binary packets by hash bucket rather than as rows.  Before that
each slice of input keeps one owner a value, so a value that a third of all
rows hold reaches its bucket once a slice, not once a row.  The number of
buckets follows the input, so a bucket's memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import release_memory
from .wordbatch import U, mix


def firsts(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs by value and owner; flags of the first pair of each value, in that order; and each pair's smallest owner."""
    order = np.lexsort((owners, values))
    v = values[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    least = owners[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(v) else owners[:0]
    return order, new, least


def packets(values: np.ndarray, owners: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, values, owners) of pairs whose values ascend."""
    if not len(values):
        return []
    bucket = (((values >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    a, b = np.ascontiguousarray(values).tobytes(), np.ascontiguousarray(owners.astype(np.int64)).tobytes()
    return [(int(bucket[x]), a[8 * x : 8 * y], b[8 * x : 8 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def by_owner(values: np.ndarray, owners: np.ndarray) -> list[tuple[int, bytes]]:
    """(owner, its values) of the pairs."""
    if not len(values):
        return []
    order = np.argsort(owners, kind="stable")
    v, o = np.ascontiguousarray(values[order]).tobytes(), owners[order]
    edges = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1, [len(o)]]).tolist()
    return [(int(o[x]), v[8 * x : 8 * y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]


def unpack(column: pa.ChunkedArray | pa.Array, dtype=U) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def values_of(column: pa.Array) -> list[np.ndarray]:
    """Each row's 64-bit values, from a binary column (null: none)."""
    return [np.frombuffer(x or b"", dtype=U) for x in column.to_pylist()]


def _home(owners: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(owners.view(U)) % U(buckets)).astype(np.int64)


def by_home(values: np.ndarray, owners: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket of the owners, values, owners): packets on their way back."""
    home = _home(owners, buckets)
    order = np.argsort(home, kind="stable")
    v, o, home = np.ascontiguousarray(values[order]).tobytes(), np.ascontiguousarray(owners[order]).tobytes(), home[order]
    edges = np.concatenate([[0], np.flatnonzero(home[1:] != home[:-1]) + 1, [len(home)]]).tolist() if len(home) else [0]
    return [(int(home[x]), v[8 * x : 8 * y], o[8 * x : 8 * y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]


def tallied(owners: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket of the owners, how often each occurs, owners)."""
    each, times = np.unique(owners, return_counts=True)
    return by_home(times.astype(U), each, buckets)


#: Packets by value that a bucket judges, and packets by owner of what slices decided themselves.
SENT, TOLD = range(2)
PACKET = "kind int, bucket int, a binary, b binary, c binary"


def packet_rows(sent: list[tuple], told: list[tuple]) -> pa.RecordBatch:
    rows = [(SENT, *x) for x in sent] + [(TOLD, *x) for x in told]
    columns = [pa.array([r[0] for r in rows], type=pa.int32()), pa.array([r[1] for r in rows], type=pa.int32())]
    columns += [pa.array([r[i] if i < len(r) else None for r in rows], type=pa.binary()) for i in (2, 3, 4)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "a", "b", "c"])


def share(values: np.ndarray, owners: np.ndarray, buckets: int, judge) -> pa.RecordBatch:
    """A slice's packets: one owner a value goes out; what the slice can decide is told."""
    order, new, _ = firsts(values, owners)
    v, o = values[order], owners[order]
    flags = judge(v, o)
    return packet_rows(packets(v[new], o[new], buckets), by_home(v[flags], o[flags], buckets))


def exchange(packets: DataFrame, answer: Callable[[pa.Table], list[tuple]], collect: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Both ways: ``answer`` turns a bucket's packets by value into packets by owner; ``collect`` gets those of a bucket of owners, and the told ones, and makes rows."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        told = table.filter(pa.array(kind == TOLD)).select(["kind", "bucket", "a", "b", "c"])
        sent = table.filter(pa.array(kind == SENT))
        return pa.concat_tables([told, pa.Table.from_batches([packet_rows([], answer(sent) if len(sent) else [])])])

    return packets.groupBy("bucket").applyInArrow(per_group(run), PACKET).groupBy("bucket").applyInArrow(per_group(collect), schema)


def resolve(packets: DataFrame, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], buckets: int) -> DataFrame:
    """``owner, found``: for each owner the values (8 bytes each) for which ``judge`` says so, given a bucket's values and owners, ordered by both."""

    def answer(table: pa.Table) -> list[tuple]:
        values, owners = unpack(table["a"]), unpack(table["b"], np.int64)
        order = np.lexsort((owners, values))
        values, owners = values[order], owners[order]
        flags = judge(values, owners)
        return by_home(values[flags], owners[flags], buckets)

    def collect(table: pa.Table) -> pa.Table:
        rows = by_owner(unpack(table["a"]), unpack(table["b"], np.int64))
        return pa.table({"owner": pa.array([r[0] for r in rows], type=pa.int64()), "found": pa.array([r[1] for r in rows], type=pa.binary())})

    return exchange(packets, answer, collect, "owner long, found binary")


def repeated(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Values that several owners hold."""
    new = np.ones(len(values) + 1, dtype=bool)
    new[1:-1] = values[1:] != values[:-1]
    run = np.cumsum(new[:-1]) - 1
    edges = np.flatnonzero(new)
    return (owners[edges[:-1]] != owners[edges[1:] - 1])[run] if len(values) else np.zeros(0, dtype=bool)


def later(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Pairs whose value has a smaller owner too."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return owners != owners[np.flatnonzero(new)][np.cumsum(new) - 1] if len(values) else np.zeros(0, dtype=bool)


def per_task(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """function, for ``mapInArrow``: at the end of a task its worker, which Spark keeps for other tasks, gives back the memory that it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release_memory()

    return run


def per_group(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """function, for ``applyInArrow``: the like after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        release_memory()
        return out

    return run


def stream(function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @per_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return run
