"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a pattern (an
item with fewer words is one shorter pattern).  Patterns of one length share a
shift table over blocks of two words: where a document's block occurs in no
pattern the search moves on by almost a whole window.  A block that ends some
pattern selects a bucket of patterns by suffix hash, and direct comparison of
the words confirms an occurrence.

The search advances many lanes (stretches of documents) at once, so each step
is one numpy operation over all lanes.

Defined results: null and word-less texts have no words and no hits; rows with
a null id are left out on both sides; repeated rows give repeated results; an
empty benchmark gives zero hits.  Only the named columns are read, so other
columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .exchange import per_task, stream
from .wordbatch import ALNUM, U, Words, inside_rows, mix, ragged, rows_of, slices

_BLOCK = U(0x9FB21C651E98DF25)
_LANE = 128
#: Patterns of one pass; a larger benchmark takes several passes over the documents, each with a broadcast of this size at most (about 100 bytes a pattern).
PASS_PATTERNS = 500_000


class PatternTable:
    """Patterns of one length: shift table, suffix buckets and the words themselves."""

    def __init__(self, hashes: np.ndarray, texts: list[bytes], items: np.ndarray):
        self.length, self.block = hashes.shape[1], min(2, hashes.shape[1])
        suffix = self._blocks(hashes, self.length - self.block)
        order = np.argsort(suffix, kind="stable")
        self.hashes, self.suffix, self.items = hashes[order], suffix[order], items[order]
        self.texts = [texts[i] for i in order.tolist()]
        bits = max(12, int(8 * len(hashes)).bit_length())
        self.mask = U((1 << bits) - 1)
        self.shift = np.full(1 << bits, min(self.length - self.block + 1, 255), dtype=np.uint8)
        for at in range(self.length - self.block + 1):
            np.minimum.at(self.shift, self._blocks(hashes, at) & self.mask, min(self.length - self.block - at, 255))

    def _blocks(self, hashes: np.ndarray, at: int) -> np.ndarray:
        h = hashes[:, at]
        return mix(h * _BLOCK + hashes[:, at + 1]) if self.block == 2 else mix(h.copy())

    def possible(self, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """First words of the windows at which the shift table can't rule an occurrence out."""
        room = np.maximum(np.diff(ptr) - self.length + 1, 0)
        lanes = -(-room // _LANE)
        row = np.repeat(np.arange(len(room)), lanes)
        step = ragged(np.zeros(len(lanes), dtype=np.int64), lanes) * _LANE
        at, limit = ptr[row] + step, ptr[row] + np.minimum(room[row], step + _LANE)
        found, tail = [], self.length - self.block
        while len(at):
            block = mix(h[at + tail] * _BLOCK + h[at + tail + 1]) if self.block == 2 else mix(h[at + tail])
            shift = self.shift[block & self.mask]
            hit = shift == 0
            if hit.any():
                found.append(at[hit])
                shift[hit] = 1
            at = at + shift
            keep = at < limit
            at, limit = at[keep], limit[keep]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def search(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        at = self.possible(h, words.ptr)
        tail = at + self.length - self.block
        value = mix(h[tail] * _BLOCK + h[tail + 1]) if self.block == 2 else mix(h[tail])
        lo, hi = np.searchsorted(self.suffix, value, side="left"), np.searchsorted(self.suffix, value, side="right")
        pattern, at = ragged(lo, hi - lo), np.repeat(at, hi - lo)
        for j in range(self.length):
            same = h[at + j] == self.hashes[pattern, j]
            at, pattern = at[same], pattern[same]
        raw = words.data.tobytes() if len(at) else b""
        start, end = words.start, words.end
        same = np.array([b" ".join(raw[start[i] : end[i]] for i in range(a, a + self.length)) == self.texts[p] for a, p in zip(at.tolist(), pattern.tolist(), strict=True)], dtype=bool)
        return at[same], pattern[same]


def compile_patterns(items: list[tuple[str, str]], window: int) -> tuple[list[PatternTable], list[str]]:
    """Tables by pattern length, and the item ids that their ``items`` index."""
    column = pa.array([t for _, t in items], type=pa.string())
    by_length: dict[int, list] = {}
    for lo, _, data, offsets in slices(column):
        words = Words(data, offsets, ALNUM, lower=True)
        h, raw = words.hashes(), words.data.tobytes()

        def add(first, row, k, words=words, h=h, raw=raw, lo=lo):
            texts = [b" ".join(raw[words.start[i] : words.end[i]] for i in range(a, a + k)) for a in first.tolist()]
            by_length.setdefault(k, []).append((h[first[:, None] + np.arange(k)], texts, row + lo))

        first, row = inside_rows(words.ptr, window)
        if len(first):
            add(first, row, window)
        for r in np.flatnonzero((words.counts > 0) & (words.counts < window)):
            add(words.ptr[r : r + 1], np.array([r]), int(words.counts[r]))
    tables = [PatternTable(np.concatenate([x[0] for x in parts]), [t for x in parts for t in x[1]], np.concatenate([x[2] for x in parts])) for _, parts in sorted(by_length.items())]
    return tables, [i for i, _ in items]


def _passes(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[tuple[list[PatternTable], list[str]]]:
    """Compiled blocks of the benchmark, one at least; the driver holds one block at a time."""
    block, patterns, any_yet = [], 0, False
    for row in benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        block.append((row[0], row[1]))
        patterns += max(1, len(row[1]) // 2)
        if patterns >= PASS_PATTERNS:
            yield compile_patterns(block, window)
            block, patterns, any_yet = [], 0, True
    if block or not any_yet:
        yield compile_patterns(block, window)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (sorted ids, as strings, of the items that occur)
    and ``spans`` (byte ranges of the text that are hit: start, end)."""
    spark = docs.sparkSession
    frame = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    state = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])
    final = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    passes = _passes(benchmark, item, item_text, window)
    current = next(passes)
    while current is not None:
        following = next(passes, None)
        shared, last = spark.sparkContext.broadcast(current), following is None

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            tables, ids = shared.value
            for batch in batches:
                for lo, hi, data, offsets in slices(batch.column(1)):
                    yield _scan_slice(batch, lo, hi, Words(data, offsets, ALNUM, lower=True), offsets, tables, ids, final if last else state)

        frame = frame.mapInArrow(per_task(scan), _ddl(last))
        if not last:
            frame = cut(frame)
            shared.unpersist()
        current = following
    return frame


def _ddl(last: bool) -> str:
    return "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" if last else "doc_id long, text string, hits binary, items array<string>"


def _scan_slice(batch, lo, hi, words, offsets, tables, ids, schema):
    h, n = words.hashes(), len(words.start)
    change = np.zeros(n + 1, dtype=np.int64)
    at_all, item_all = [], []
    for table in tables:
        at, pattern = table.search(words, h)
        np.add.at(change, at, 1)
        np.add.at(change, at + table.length, -1)
        at_all.append(at)
        item_all.append(table.items[pattern])
    hit = np.cumsum(change[:n]) > 0
    before = batch.column(2).slice(lo, hi - lo)
    if before.null_count < len(before):  # a pass went before
        for r, bits in enumerate(before.to_pylist()):
            if bits is not None:
                a, b = words.ptr[r], words.ptr[r + 1]
                hit[a:b] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
    items: list[set] = [set(x) for x in batch.column(3).slice(lo, hi - lo).to_pylist()]
    if tables and (at := np.concatenate(at_all)).size:
        row = np.searchsorted(words.ptr, at, side="right") - 1
        for r, i in set(zip(row.tolist(), np.concatenate(item_all).tolist(), strict=True)):
            items[r].add(ids[i])
    doc_id = pa.array(rows_of(batch, "doc_id", lo, hi))
    found = pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))
    if "hits" in schema.names:
        bits = pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True)], type=pa.binary())
        return pa.RecordBatch.from_arrays([doc_id, batch.column(1).slice(lo, hi - lo), bits, found], schema=schema)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[words.ptr[1:]] - total[words.ptr[:-1]]
    spans: list[list[dict]] = [[] for _ in range(hi - lo)]
    for r in np.flatnonzero(n_hit):
        a, b = words.ptr[r], words.ptr[r + 1]
        flags = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
        for x, y in zip(np.flatnonzero(flags == 1), np.flatnonzero(flags == -1), strict=True):
            spans[r].append({"start": int(words.start[a + x] - offsets[r]), "end": int(words.end[a + y - 1] - offsets[r])})
    return pa.RecordBatch.from_arrays([doc_id, pa.array(words.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), found, pa.array(spans, type=schema.field("spans").type)], schema=schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents (all their columns) without any benchmark window; nothing is shuffled."""
    at = docs.columns.index(text)
    for tables, _ in _passes(benchmark, item, item_text, window):
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, _, data, offsets in slices(batch.column(at)):
                words = Words(data, offsets, ALNUM, lower=True)
                h = words.hashes()
                for table in shared.value:
                    keep[lo + np.searchsorted(words.ptr, table.search(words, h)[0], side="right") - 1] = False
            yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(stream(run), docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
pattern AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
lengths AS (SELECT DISTINCT k FROM pattern),
hit AS (
  SELECT doc_id, i, k, item
  FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k))
  JOIN pattern USING (k, p)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
