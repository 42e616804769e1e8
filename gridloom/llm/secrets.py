"""Secret scanning: fixed patterns, and a linear-chain conditional random field that adds to them.

Texts become tokens (runs of letters, digits and ``+/_.-``).  The field tags
each token as the begin of a secret, inside one, or outside, from its shape
(length, kinds of characters and how often they alternate, whether it is all
hexadecimal), the words and shapes beside it, the gap before it, and features
of the whole file.  It is trained by gradient ascent on the likelihood, with
the patterns' matches in a bounded sample as labels (``TRAIN_DOCS`` texts of
at most ``TRAIN_CHARS`` characters), and decoded by Viterbi.  Tokens that are
outside whatever their neighbours are cut the chain, which leaves Viterbi's
result as it is; only the stretches between them are searched, all at once.

Defined results: a null text is empty and has no secrets; rows with a null id
are left out; repeated rows are scanned alike; of a pattern's matches those
that fail its length are dropped; a field's span that touches a pattern's is
dropped.  Only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import stream
from .wordbatch import LOWER, U, Words, byte_class, mix, rows_of, slices, span_hashes

# The patterns, and the least length of what they match (of group 2, for assign).
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]

TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
_OUT, _BEGIN, _IN = range(3)
_WORDS, _SHAPES, _GAPS = 1 << 13, 1 << 10, 6
_TOKEN = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), (0x2B, 0x2B), (0x2D, 0x2F), (0x5F, 0x5F))
_KIND = np.full(256, 8, dtype=np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 1, 2, 4
_HEX = byte_class((0x30, 0x39), (0x61, 0x66))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in code points, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Tokens:
    """Tokens of a slice and the numbers of their features, one table each."""

    #: name, size and shift of the tables; a shift of 1 takes the token before, -1 the one after
    TABLES = [("shape", _SHAPES, 0), ("word", _WORDS, 0), ("gap", _GAPS, 0), ("word", _WORDS, 1), ("word", _WORDS, 2), ("shape", _SHAPES, 1), ("shape", _SHAPES, -1), ("file", 64, 0), ("gapshape", _GAPS * _SHAPES, 0)]

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = self.words = Words(data, offsets, _TOKEN)
        n, row = len(w.start), w.rows()
        size = w.end - w.start
        kind = _KIND[data]
        bounds = np.empty(2 * n, dtype=np.int64)
        bounds[0::2], bounds[1::2] = w.start, w.end
        reduce = (lambda f, x: f.reduceat(np.append(x, x[:0].dtype.type(0)), bounds)[0::2]) if n else (lambda f, x: x[:0])
        kinds = reduce(np.bitwise_or, kind).astype(np.int64)
        change = np.zeros(len(data), dtype=np.int32)
        change[1:] = kind[1:] != kind[:-1]
        changes = reduce(np.add, change) - (change[w.start] if n else 0)
        all_hex = reduce(np.add, _HEX[data].astype(np.int32)) == size
        level = np.searchsorted([3, 6, 9, 13, 20, 24, 40], size, side="right")
        shape = ((kinds & 15) * 8 + level) * 8 + np.minimum(changes * 3 // np.maximum(size // 2, 1), 3) * 2 + all_hex
        before = np.where(np.r_[True, row[1:] != row[:-1]] if n else np.zeros(0, bool), offsets[:-1][row] if n else w.start, np.r_[0, w.end[:-1]] if n else w.end)
        count = lambda flags: (lambda c: c[w.start] - c[before])(np.concatenate([[0], np.cumsum(flags)]))
        assign, quote, line = count((data == 0x3D) | (data == 0x3A)), count((data == 0x22) | (data == 0x27)), count(data == 0x0A)
        gap = np.select([line > 0, (assign > 0) & (quote > 0), assign > 0, quote > 0, w.start - before <= 1], [1, 2, 3, 4, 5], 0)
        word = np.where(size <= 16, mix(span_hashes(LOWER[data], w.start, w.end)) % U(_WORDS - 2) + U(2), U(1)).astype(np.int64)
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.ptr])
        total = np.maximum(w.counts, 1)
        share = np.minimum(per(assign > 0) * 20 // total, 3) * 16 + np.minimum(per((kinds & 4) > 0) * 10 // total, 3) * 4 + np.searchsorted([50, 300, 2000], w.counts)
        self.row, self.columns = row, {"shape": shape, "word": word, "gap": gap, "file": share[row], "gapshape": gap * _SHAPES + shape}

    def features(self) -> list[np.ndarray]:
        out = []
        for name, _, shift in self.TABLES:
            x = self.columns[name]
            if shift:
                y, n = np.zeros_like(x), len(x)
                if shift > 0:
                    y[shift:] = np.where(self.row[shift:] == self.row[:-shift], x[: max(n - shift, 0)], 0) if n > shift else y[shift:]
                elif n > 1:
                    y[:-1] = np.where(self.row[1:] == self.row[:-1], x[1:], 0)
                x = y
            out.append(x)
        return out


class Field:
    """A linear-chain conditional random field over the labels outside, begin, inside."""

    def __init__(self):
        self.tables = [np.zeros((size, 3)) for _, size, _ in Tokens.TABLES]
        self.tables[0][:, _OUT] += 1  # a shape never seen is outside
        self.steps = np.zeros((3, 3))
        self.steps[_OUT, _IN] = -np.inf

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(features[0]), 3))
        for table, x in zip(self.tables, features, strict=True):
            out += table[x]
        return out

    def learn(self, chain: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        """One step up the gradient of a chain's log likelihood (forward-backward)."""
        e = self.emissions(chain)
        n, step = len(e), np.exp(self.steps)
        x = np.exp(e - e.max(axis=1, keepdims=True))
        first = np.array([1.0, 1.0, 0.0])
        a, b = np.empty((n, 3)), np.ones((n, 3))
        a[0] = x[0] * first / (x[0] * first).sum()
        for t in range(1, n):
            a[t] = (a[t - 1] @ step) * x[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = step @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = a * b
        p /= p.sum(axis=1, keepdims=True)
        gradient = -p
        gradient[np.arange(n), labels] += 1
        for table, f in zip(self.tables, chain, strict=True):
            np.add.at(table, f, rate * gradient)
            table[f] *= 1 - rate * 1e-3
        if n > 1:
            q = a[:-1, :, None] * step[None] * (x[1:] * b[1:])[:, None, :]
            q /= q.sum(axis=(1, 2), keepdims=True)
            change = -q.sum(axis=0)
            np.add.at(change, (labels[:-1], labels[1:]), 1)
            self.steps += rate * 0.1 * np.where(np.isfinite(self.steps), change, 0)

    def margins(self) -> tuple[np.ndarray, np.ndarray]:
        """What begin and inside can gain at most over outside by the steps around a token: if the next isn't inside, and if it is and becomes a begin instead."""
        s = self.steps
        plain, followed = np.full(3, -np.inf), np.full(3, -np.inf)
        for y in (_BEGIN, _IN):
            into = max([0.0 if y == _BEGIN else -np.inf, *(s[p, y] - s[p, _OUT] for p in range(3))])  # 0: the first of its chain
            plain[y] = into + max(0.0, *(s[y, x] - s[_OUT, x] for x in (_OUT, _BEGIN)))
            followed[y] = into + s[y, _IN] - s[_OUT, _BEGIN] + max(0.0, *(s[_IN, x] - s[_BEGIN, x] for x in range(3)))
        return plain, followed

    def decode(self, e: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Viterbi's labels of the chains e[ptr[i]:ptr[i+1]].

        A token is surely outside if that gains more than any change of steps around it, and of the next token's label from inside to begin, can lose."""
        labels = np.zeros(len(e), dtype=np.int8)
        if not len(e):
            return labels
        plain, followed = self.margins()
        after = np.zeros(len(e))
        after[:-1] = e[1:, _IN] - e[1:, _BEGIN]
        sure = np.ones(len(e), dtype=bool)
        for y in (_BEGIN, _IN):
            sure &= e[:, _OUT] - e[:, y] > np.maximum(plain[y], followed[y] + after) + 1e-9
        doubt = np.flatnonzero(~sure)
        if not len(doubt):
            return labels
        row = np.searchsorted(ptr, doubt, side="right")
        new = np.r_[True, (np.diff(doubt) > 1) | (row[1:] != row[:-1])]
        edges = np.append(np.flatnonzero(new), len(doubt))
        lo, hi = doubt[edges[:-1]], doubt[edges[1:] - 1] + 1
        order = np.argsort(lo - hi, kind="stable")
        self._viterbi(e, lo[order], (hi - lo)[order], np.isin(lo, ptr)[order], np.isin(hi, ptr)[order], labels)
        return labels

    def _viterbi(self, e: np.ndarray, lo: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray, labels: np.ndarray) -> None:
        """Sets the best labels of the stretches e[lo:lo+size], the longest first; where one doesn't begin or end its chain, the token beside it is outside."""
        best = e[lo] + np.where(first[:, None], [0, 0, -np.inf], self.steps[_OUT])
        back, final = [], np.empty((len(lo), 3))
        for t in range(1, int(size[0])):  # a step of all stretches that are longer
            k = int(np.searchsorted(-size, -t))
            final[k : len(best)] = best[k:]
            way = best[:k, :, None] + self.steps
            back.append(way.argmax(axis=1).astype(np.int8))
            best = way.max(axis=1) + e[lo[:k] + t]
        final[: len(best)] = best
        now = (final + np.where(last[:, None], 0, self.steps[:, _OUT])).argmax(axis=1)
        labels[lo + size - 1] = now
        for t in range(int(size[0]) - 1, 0, -1):
            k = len(back[t - 1])
            now[:k] = back[t - 1][np.arange(k), now[:k]]
            labels[lo[:k] + t - 1] = now[:k]


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves within the patterns' matches, as byte ranges."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(s, t) for s, k, t in base_spans(text) if k]
    return [(len(text[:s].encode()), len(text[:t].encode())) for s, t in sorted(spans)]


def train(texts: list[str], seed: int = 5) -> Field:
    """A field fitted to the lines that hold a pattern's match, as many others, and those that it tags wrongly on the way."""
    field, rng, chains = Field(), np.random.default_rng(seed), []
    for lo, hi, data, offsets in slices(pa.array(texts, type=pa.string())):
        tokens = Tokens(data, offsets)
        features, w = tokens.features(), tokens.words
        labels = np.zeros(len(w.start), dtype=np.int64)
        for r in range(hi - lo):
            for s, t in _secret_parts(texts[lo + r]):
                inside = np.flatnonzero((w.start[w.ptr[r] : w.ptr[r + 1]] < offsets[r] + t) & (w.end[w.ptr[r] : w.ptr[r + 1]] > offsets[r] + s)) + w.ptr[r]
                labels[inside] = _IN
                labels[inside[:1]] = _BEGIN
        cut = np.flatnonzero(np.r_[True, (tokens.columns["gap"][1:] == 1) | (tokens.row[1:] != tokens.row[:-1])]) if len(labels) else []
        for a, b in zip(cut, [*cut[1:], len(labels)], strict=True):
            chains.append((a, b, labels[a:b], [f[a:b] for f in features]))
    good = [c for c in chains if c[2].any()]
    other = [c for c in chains if not c[2].any()]
    other = [other[i] for i in rng.permutation(len(other))]
    use, other = good + other[: max(len(good), 200)], other[max(len(good), 200) :]
    for epoch in range(6):
        parts = [(y[k : k + 120], [f[k : k + 120] for f in x]) for _, _, y, x in use for k in range(0, len(y), 120)]
        for i in rng.permutation(len(parts)):
            y, x = parts[i]
            if y[0] != _IN:
                field.learn(x, y, 0.3 / (1 + epoch))
        if 1 <= epoch <= 3:  # lines that are tagged wrongly so far join in
            ends = np.cumsum([0, *(len(c[2]) for c in other)])
            tagged = field.decode(field.emissions([np.concatenate(x) for x in zip(*(c[3] for c in other), strict=True)]), ends) if other else ends[:0]
            wrong = [tagged[a:b].any() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            use += [c for c, bad in zip(other, wrong, strict=True) if bad]
            other = [c for c, bad in zip(other, wrong, strict=True) if not bad]
    return field


def fit(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> Field:
    """A field from a bounded sample: the first ``TRAIN_DOCS`` by a hash of the id whose text an assignment or an access key may be in, and as many of all."""
    near = docs.where(F.col(doc).isNotNull() & (F.length(text) <= TRAIN_CHARS)).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hint = F.col("text").contains("AKIA") | F.lower("text").rlike("(passw|secret|token|api_?key)[a-z]*[\"']? *[:=]")
    first = lambda df: df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    ids = first(near.where(hint)).union(first(near)).distinct()
    rows = near.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(4 * TRAIN_DOCS).collect()
    return train([r.text for r in rows])


def outside(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a span outside those taken: all of it, or its parts that hold letters or digits, without blanks around."""
    parts = [(start, end)]
    for x, y in taken:
        parts = [(a, b) for s, t in parts for a, b in ([(s, t)] if t <= x or s >= y else [(s, min(x, t)), (max(y, s), t)]) if a < b]
    if parts == [(start, end)]:
        return parts
    found = []
    for s, t in parts:
        part = text[s:t]
        if any(c.isalnum() for c in part):
            found.append((s + len(part) - len(part.lstrip()), t - len(part) + len(part.rstrip())))
    return found


def scan(docs: DataFrame, field: Field, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: kind, start and end (code points, end exclusive) of every secret, by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # tables of fixed size

    def run(batch: pa.RecordBatch):
        model = shared.value
        for lo, hi, data, offsets in slices(batch.column(1)):
            tokens = Tokens(data, offsets)
            w = tokens.words
            labels = model.decode(model.emissions(tokens.features()), w.ptr)
            begin = np.flatnonzero(labels == _BEGIN)
            stop = np.flatnonzero((labels != _OUT) & (np.r_[labels[1:], 0] != _IN))
            stop = stop[np.searchsorted(stop, begin)] if len(begin) else stop[:0]
            added: dict[int, list] = {}
            for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                added.setdefault(int(tokens.row[a]), []).append((int(w.start[a]), int(w.end[b])))
            out = []
            for r, value in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                value = value or ""
                spans = base_spans(value)
                taken = [(s, t) for s, _, t in spans]
                raw = value.encode() if r in added else b""
                for a, b in added.get(r, ()):
                    s = len(raw[: a - offsets[r]].decode())
                    t = s + len(raw[a - offsets[r] : b - offsets[r]].decode())
                    spans += [(x, 3, y) for x, y in outside(value, s, t, taken)]
                out.append([{"kind": KINDS[k], "start": s, "end": t} for s, k, t in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows_of(batch, "doc_id", lo, hi)), pa.array(out, type=kind)], names=["doc_id", "spans"])

    source = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(stream(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
