"""Substring deduplication over Rabin-Karp hashes of every fixed-length word window.

A word goes if a window of ``width`` words that covers it also starts in a
document with a smaller id.  The hash of every window is computed; two rounds
keep the traffic small without losing a window:

1. A window's *selector* is the smallest hash of the ``GRAM``-word runs in it.
   Equal windows have equal selectors, and neighbouring windows mostly share
   one, so selectors (about one for each 20 words) are counted first.
2. Windows whose selector occurs in several documents are counted by their
   full hash; those that a smaller document holds too are removed, and
   overlapping windows merge into maximal intervals.

Defined results: a null or empty text has no words and keeps the empty string;
a text of fewer than ``width`` words keeps all its words; windows repeated
within one document alone stay; rows with a null id are left out; rows of
equal id count as one document.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import buckets_for
from .exchange import PACKET, later, repeated, resolve, share, stream, values_of
from .wordbatch import NOT_SPACE, U, Words, inside_rows, mix, rows_of, slices, sliding_min, windows

GRAM = 8
_FINAL = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string"


class Windows:
    """Windows of a slice of texts: first word, row, full hash and selector."""

    def __init__(self, data, offsets, width: int):
        self.words, self.offsets, self.width = Words(data, offsets, NOT_SPACE), offsets, width
        h = self.words.hashes()
        self.first, self.row = inside_rows(self.words.ptr, width)
        gram = min(GRAM, width)
        select = sliding_min(mix(windows(h, gram)), width - gram + 1)
        self.selector = select[self.first] if len(self.first) else select[:0]
        self._h = h

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        return mix(windows(self._h, self.width)[self.first[chosen]]) if len(chosen) else np.zeros(0, dtype=U)

    def kept(self, remove: np.ndarray) -> list[bytes]:
        """Each row's words that aren't removed, joined by one space."""
        w, n = self.words, len(self.words.data)
        keep = np.flatnonzero(~remove)
        start, end = w.start[keep], w.end[keep]
        limit = self.offsets[np.searchsorted(w.ptr, keep, side="right")]
        text = w.data.copy()
        text[end[end < limit]] = 0x20
        change = np.zeros(n + 2, dtype=np.int8)
        np.add.at(change, start, 1)
        np.add.at(change, np.minimum(end + 1, limit), -1)
        mask = np.cumsum(change[:n], dtype=np.int8) > 0
        at = np.concatenate([[0], np.cumsum(mask)])[self.offsets]
        raw = text[mask].tobytes()
        return [x[:-1] if x.endswith(b" ") else x for x in (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]


def remove_repeats(docs: DataFrame, width: int = 50, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (maximal runs of removed words: first, last) and ``kept`` (the words left, joined by one space)."""
    source = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = buckets_for(source)

    def selectors(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            w = Windows(data, offsets, width)
            new = np.ones(len(w.first), dtype=bool)
            new[1:] = (w.selector[1:] != w.selector[:-1]) | (w.row[1:] != w.row[:-1])
            yield share(w.selector[new], rows_of(batch, "doc_id", lo, hi)[w.row[new]], buckets, repeated)

    shared = resolve(source.mapInArrow(stream(selectors), PACKET), repeated, buckets)

    def candidates(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            w, ids = Windows(data, offsets, width), rows_of(batch, "doc_id", lo, hi)
            values = np.unique(np.concatenate(values_of(batch.column(2).slice(lo, hi - lo)) or [w.selector[:0]]))
            chosen = np.flatnonzero(np.isin(w.selector, values)) if len(values) else w.first[:0]
            yield share(w.hashes(chosen), ids[w.row[chosen]], buckets, later)

    joined = source.join(shared.withColumnRenamed("owner", "doc_id"), "doc_id").select("doc_id", "text", "found")
    doomed = resolve(joined.mapInArrow(stream(candidates), PACKET), later, buckets)

    def final(batch: pa.RecordBatch):
        for lo, hi, data, offsets in slices(batch.column(1)):
            w = Windows(data, offsets, width)
            remove = np.zeros(len(w.words.start) + 1, dtype=np.int64)
            # hashes that are removed from one document aren't from the smallest that holds them, so rows are told apart
            per_row = values_of(batch.column(2).slice(lo, hi - lo))
            edges = np.searchsorted(w.row, np.arange(hi - lo + 1))
            for r, values in enumerate(per_row):
                if len(values):
                    own = np.arange(edges[r], edges[r + 1])
                    at = w.first[own[np.isin(w.hashes(own), values)]]
                    np.add.at(remove, at, 1)
                    np.add.at(remove, at + width, -1)
            gone = np.cumsum(remove[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            spans = []
            for r in range(hi - lo):
                a, b = w.words.ptr[r], w.words.ptr[r + 1]
                flags = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(flags == 1), np.flatnonzero(flags == -1), strict=True)])
            n = total[w.words.ptr[1:]] - total[w.words.ptr[:-1]]
            run = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows_of(batch, "doc_id", lo, hi)), pa.array(w.words.counts.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(spans, type=run), pa.array([x.decode() for x in w.kept(gone)], type=pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    return source.join(doomed.withColumnRenamed("owner", "doc_id"), "doc_id", "left").select("doc_id", "text", "found").mapInArrow(stream(final), _FINAL)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM late) GROUP BY doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
out AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(js) AS j FROM gone) AS g),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN out ON word.doc_id = out.doc_id AND word.i = out.j GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
