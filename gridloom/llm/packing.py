"""Best-fit sequence packing with exact-complement hashing.

Texts become token ids (a public tokenizer's file is a parameter) plus an end
id.  A piece is a document, or a part of one that is longer than a sequence;
of those only the first part may be shorter than a sequence.

The plan works on the number of pieces of each length, at most ``capacity``
counts however large the corpus is.  From the longest length on, a hash index
of single, pair and triple sums (``Sums``) gives combinations that fill the gap
exactly; they are consumed as often as the counts allow.  What has no exact
complement is packed best fit (the longest piece that fits).  Every task numbers
its pieces of each length; Spark adds what the tasks before it have (one row a
task and length) and looks the places up in the plan.

Defined results: a null or empty text is the end id alone; rows with a null id
are left out; repeated rows are pieces of their own; an empty table gives an
empty result.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut
from .exchange import per_task, stream
from .wordbatch import U, ragged, rows_of, slices, span_hashes

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task long, nth long"


class SegmentTokenizer:
    """Token ids of many texts at once: texts are cut at plain blanks, where byte-level BPE never joins, and every distinct segment is encoded once.

    A blank is plain if both neighbours are ASCII and not white space, or letters U+00C0 to U+00FF.  Known segments are kept up to a bound of memory."""

    KEEP, TOGETHER = 600_000, 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token that stands for itself parts segments that are encoded together
        marks = [(t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.mark_id = marks[0] if marks else (None, -1)
        safe = np.zeros(256, dtype=bool)
        safe[0x21:0x7F] = True
        self.after = safe.copy()
        self.after[0xC3] = True
        self.before = safe
        self._forget()

    def _forget(self):
        self.known, self.at, self.n, self.ids = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        if len(self.known) > self.KEEP:
            self._forget()
        ids, n = self._encode_all(texts)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.known, h)  # both ascend
        self.known, self.at, self.n = np.insert(self.known, place, h), np.insert(self.at, place, at), np.insert(self.n, place, n)

    def _encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if self.mark is None or any(self.mark in t for t in texts):
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            n = np.array([len(x) for x in found], dtype=np.int64)
            return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(n.sum())), n
        groups = [self.mark.join(texts[i : i + self.TOGETHER]) + self.mark for i in range(0, len(texts), self.TOGETHER)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=sum(map(len, found)))
        ends = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row pointers) of the UTF-8 rows ``data[offsets[i]:offsets[i+1]]``."""
        n = len(data)
        cuts = np.zeros(n + 1, dtype=bool)
        if n > 2:
            end_ok = self.before[data[:-2]].copy()
            if n > 3:  # the end of a letter of two bytes, C3 xx
                end_ok[1:] |= (data[:-3] == 0xC3) & (data[1:-2] >= 0x80)
            cuts[1 : n - 1] = (data[1:-1] == 0x20) & end_ok & self.after[data[2:]]
            inner = offsets[(offsets > 0) & (offsets < n)]
            cuts[inner] = False  # a blank between two rows' bytes has no neighbours
            cuts[np.maximum(inner - 1, 0)] = False
        cuts[offsets[:-1][np.diff(offsets) > 0]] = True
        cuts[n] = False
        start = np.flatnonzero(cuts[:n])
        end = np.append(start[1:], n)
        h = span_hashes(data, start, end)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        new = place >= len(self.known)
        new[~new] = self.known[place[~new]] != unique[~new]
        if new.any():
            size = len(self.known)
            raw = data.tobytes()
            wanted = np.flatnonzero(new) if size <= self.KEEP else np.arange(len(unique))
            self._learn(unique[wanted], [raw[start[i] : end[i]].decode() for i in first[wanted].tolist()])
            place = np.searchsorted(self.known, unique)
        row_start = np.searchsorted(start, offsets)
        seg = place[inverse]
        n_ids = self.n[seg] if len(seg) else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(n_ids)])
        return self.ids[ragged(self.at[seg], n_ids)] if len(seg) else np.zeros(0, dtype=np.uint32), total[row_start]


_coders: dict[str, SegmentTokenizer] = {}


def coder_of(path: str) -> SegmentTokenizer:
    """One tokenizer a worker process: the tasks that it runs share the known segments."""
    if path not in _coders:
        _coders[path] = SegmentTokenizer(path)
    return _coders[path]


class Sums:
    """Hash index from a sum to the single length, the pairs and the triples of lengths that make it.

    A pair is kept by its larger member, a triple by its largest one and the rest's sum, which is looked up among the pairs.  Counts only fall, so
    entries whose lengths are used up are dropped for good.  The pairs of all sums are at most capacity ** 2 / 4; a sum's triples are indexed when it is
    first asked for."""

    def __init__(self, left: np.ndarray):
        self.left = left
        lengths = np.flatnonzero(left)
        self.pairs: dict[int, np.ndarray] = {}
        self.triples: dict[int, np.ndarray] = {}
        larger = np.concatenate([np.full(np.searchsorted(lengths, min(x, len(left) - 1 - x), side="right"), x) for x in lengths] or [lengths])
        smaller = np.concatenate([lengths[: np.searchsorted(lengths, min(x, len(left) - 1 - x), side="right")] for x in lengths] or [lengths])
        order = np.argsort(larger + smaller, kind="stable")
        sums = (larger + smaller)[order]
        edges = [*np.flatnonzero(np.diff(sums, prepend=-1)).tolist(), len(sums)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            self.pairs[int(sums[x])] = larger[order[x:y]]

    def times(self, shape: tuple[int, ...]) -> int:
        """How often the lengths are there together."""
        need: dict[int, int] = defaultdict(int)
        for x in shape:
            need[x] += 1
        return min(int(self.left[x]) // k for x, k in need.items())

    def single(self, total: int, most: int) -> tuple[int, ...] | None:
        return (total,) if 0 < total <= most and self.left[total] else None

    def pair(self, total: int, most: int) -> tuple[int, ...] | None:
        """Of the pairs whose members are ``most`` at most, the one that is there most often."""
        a = self.pairs.get(total)
        if a is None:
            return None
        able = np.where(2 * a == total, self.left[a] // 2, np.minimum(self.left[a], self.left[total - a]))
        if not able.all():
            a, able = a[able > 0], able[able > 0]
            self.pairs[total] = a
        i = int(np.argmax(np.where(a <= most, able, 0))) if len(a) else 0
        return (int(a[i]), total - int(a[i])) if len(a) and a[i] <= most else None

    def triple(self, total: int, most: int, beside: int) -> tuple[int, ...] | None:
        """The triple with the largest member of ``most`` at most that is there beside a piece of length ``beside``."""
        if total not in self.triples:
            third = np.flatnonzero(self.left[: total - 1]) if total > 2 else np.zeros(0, dtype=np.int64)
            self.triples[total] = np.array([x for x in third.tolist()[::-1] if total - x in self.pairs], dtype=np.int64)
        kept = self.triples[total] = self.triples[total][self.left[self.triples[total]] > 0]
        for x in kept[(kept <= most) & (self.left[kept] > (kept == beside))].tolist():
            self.left[x] -= 1
            self.left[beside] -= 1
            two = self.pair_without(total - x, x)
            self.left[x] += 1
            self.left[beside] += 1
            if two:
                return (x, *two)
        return None

    def pair_without(self, total: int, most: int) -> tuple[int, ...] | None:
        """``pair`` while some lengths are set aside: nothing is dropped."""
        kept = self.pairs.get(total)
        found = self.pair(total, most)
        if kept is not None:
            self.pairs[total] = kept
        return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many sequences) for the number of pieces of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(shape: tuple[int, ...], times: int) -> None:
        for x in shape:
            left[x] -= times
        out.append((shape, times))

    index = Sums(left)
    for longest in range(capacity, 0, -1):
        while left[longest]:
            gap = capacity - longest
            shape = (longest,) if gap == 0 else None
            for found in (index.single, index.pair):
                if shape is None and (rest := found(gap, longest)) and index.times((longest, *rest)):
                    shape = (longest, *rest)
            if shape is None and (rest := index.triple(gap, longest, longest)):
                shape = (longest, *rest)
            if shape is None:  # best fit: ever the longest piece that fits
                parts, room = [longest], gap
                left[longest] -= 1
                while room and len(fit := np.flatnonzero(left[1 : room + 1])):
                    x = int(fit[-1]) + 1
                    parts.append(x)
                    left[x] -= 1
                    room -= x
                for x in parts:
                    left[x] += 1
                shape = tuple(parts)
            use(shape, index.times(shape))
    return out


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = 2048, end_id: int = 0, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. tokenizer: a file of the tokenizers library, or a function that finds it on an executor."""
    source = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder = coder_of(tokenizer() if callable(tokenizer) else tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

        def run(batch: pa.RecordBatch):
            for lo, hi, data, offsets in slices(batch.column(1)):
                ids, ptr = coder.encode(data, offsets)
                n = np.diff(ptr) + 1
                ptr = ptr + np.arange(len(ptr))
                full = np.full(int(ptr[-1]), end_id, dtype="<u4")
                keep = np.ones(len(full), dtype=bool)
                keep[ptr[1:] - 1] = False
                full[keep] = ids
                k = -(-n // capacity)
                row, piece = np.repeat(np.arange(len(n)), k), ragged(np.zeros(len(k), dtype=np.int64), k)
                head = n - (k - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                raw, a = full.tobytes(), ptr[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                new = np.r_[True, np.diff(length[order]) != 0] if len(order) else np.zeros(0, dtype=bool)
                nth = np.empty(len(order), dtype=np.int64)
                nth[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else 0
                nth += seen[length]
                seen[:] += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows_of(batch, "doc_id", lo, hi)[row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(np.array(crc, dtype=np.int64)), pa.array(np.full(len(row), task)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

        for batch in batches:
            yield from run(batch)

    table = cut(source.mapInArrow(per_task(pieces), _PIECES))
    counted = cut(table.groupBy("task", "length").agg(F.count("*").alias("m")))
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("m")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("task", "length", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    used, sequence, places = defaultdict(int), 0, defaultdict(list)
    for shape, times in plan(counts, capacity):
        offset = 0
        of_length: dict[int, list[int]] = defaultdict(list)
        for x in shape:
            of_length[x].append(offset)
            offset += x
        for x, offsets in of_length.items():  # numbers used[x] .. of length x: len(offsets) to a sequence
            places[x].append((used[x], sequence, len(offsets), offsets))
            used[x] += times * len(offsets)
        sequence += times
    # as many places as the plan has shapes: bounded by the capacity, not by the corpus
    lookup = docs.sparkSession.sparkContext.broadcast({x: (np.array([p[0] for p in ps]), ps) for x, ps in places.items()})

    def placed(batch: pa.RecordBatch):
        length, number = (batch.column(i).to_numpy() for i in (3, 5))
        seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for i, (x, r) in enumerate(zip(length.tolist(), number.tolist(), strict=True)):
            firsts, ps = lookup.value[x]
            first, base, each, offsets = ps[int(np.searchsorted(firsts, r, side="right")) - 1]
            seq[i], off[i] = base + (r - first) // each, offsets[(r - first) % each]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.int64()), batch.column(4), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = table.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(stream(placed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer)
