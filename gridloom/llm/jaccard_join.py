"""N-gram Jaccard self-join of documents with token-combination prefixes.

A document is the set of its distinct k-word shingles ("tokens", 64-bit
hashes); equal sets are one class.  Sets of sizes n, m with Jaccard similarity
t or more share k tokens within the first ``n - ceil(t n) + k`` tokens of each
in any common order, for every k up to their overlap.  This is used twice:

1. By hash order, with a prefix extended by a twentieth of the set: a class
   that shares too few of these tokens with other classes can't link at all.
   Only prefixes travel, and most documents end here.
2. By frequency.  First each class is compared with the most central class of
   those that share one of its smallest hashes, which joins groups of near
   copies.  Frequencies then count components, not classes: a token that only
   one component holds can't lead to a new link.  In the order of unknown,
   rare (by count) and frequent tokens the prefix is extended by a tenth of
   the set.  Single tokens of the rare class are index keys; tokens of the
   frequent class are dealt to fewer places than the shared ones that the
   prefix must hold, so two of them share a place, and 2-token combinations
   within a place are keys.  A key's classes are compared where they meet:
   sizes and the tokens known to other components first (the smaller class
   needs nearly all its tokens known, so most lists have no pair), then odd
   sketches; the rest is verified by an exact count of common tokens.

Defined results: null or word-less texts are empty sets, linked with nothing;
rows with a null id are left out; repeated rows are of one class; with fewer
than k words the whole sequence is the one shingle.  Only the named columns
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import beside, buckets_for, cut
from .components import components
from .exchange import PACKET, by_home, by_owner, exchange, firsts, packet_rows, packets, per_group, stream, tallied, unpack
from .wordbatch import NOT_SPACE, U, Words, mix, packed, ragged, rows_of, shingle_sets, slices

#: A token that more components hold, or that as many as LOCAL classes of one slice hold, is of the frequent class.
RARE, LOCAL = 32, 8
_FREQUENT = RARE + 1
#: 64-bit words of a set's odd sketch; smallest hashes by which central classes are found; tokens and pairs handled at once.
_ODD, _MINIMA, _TOKENS, _PAIRS = 8, 4, 1 << 20, 1 << 20


def _share(n: int, percent: int) -> int:
    """ceil(percent/100 * n): the least overlap with any partner."""
    return -(-percent * n // 100)


def _class_of(tokens: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Hash of each row's set: its tokens come ordered."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(tokens + U(0x5851F42D4C957F2D)), dtype=U)])
    return mix(sums[ptr[1:]] - sums[ptr[:-1]] + np.diff(ptr).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(column: pa.Array, k: int):
    for lo, hi, data, offsets in slices(column):
        tokens, ptr = shingle_sets(Words(data, offsets, NOT_SPACE, lower=True), k)
        yield lo, hi, tokens, ptr


def _odd(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of 512 places: sets differ in at least as many tokens as places."""
    odd = np.bincount((mix(tokens + U(3)) % U(64 * _ODD)).astype(np.int64), minlength=64 * _ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def band_of(n: int, percent: int) -> int:
    """Size bands whose width is a little over the largest ratio of linked sizes: partners are of one band or of neighbours."""
    return int(math.log(n) / math.log(1.001 * 100 / percent))


def combined(band: int, percent: int) -> int:
    """How many shared tokens the prefixes of a band's index hold: no more than any overlap there, and a tenth of the set or so."""
    least = max(1, math.ceil((1.001 * 100 / percent) ** band - 1e-6))
    return min(_share(least, percent), max(2, 1 + least // 10))


def index_keys(n: int, tokens: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a class of n tokens, of which ``tokens`` are known to other components, ``df`` of them; and which are for larger partners alone:
    combinations of the next band, where two classes of one band needn't meet again."""
    order, band, spare = np.lexsort((tokens, df)), band_of(n, percent), n - _share(n, percent) - (n - len(tokens))
    tokens, often = tokens[order], df[order] > RARE
    singles, pairs = [], [np.zeros(0, dtype=U)] * 2
    for b in (band, band + 1):
        k = combined(b, percent)
        prefix = slice(0, max(0, spare + k))
        singles.append(tokens[prefix][~often[prefix] | (k == 1)])
        if k == 1:
            continue
        common = tokens[prefix][often[prefix]]
        place = (mix(common + U(5)) % U(k - 1)).astype(np.int64)
        common = common[np.argsort(place, kind="stable")]
        size = np.bincount(place, minlength=k - 1)
        behind = np.concatenate([np.arange(x - 1, -1, -1) for x in size.tolist() if x] or [np.zeros(0, dtype=np.int64)])
        i = np.repeat(np.arange(len(common)), behind)
        j = ragged(np.arange(len(common)) + 1, behind)
        x, y = np.minimum(common[i], common[j]), np.maximum(common[i], common[j])
        pairs[b - band] = mix(x * U(0x2545F4914F6CDD1D) + mix(y + U(2 + 0x9E3779B97F4A7C15 * b & 0xFFFFFFFFFFFFFFFF)))
    singles = mix(np.unique(np.concatenate(singles)) + U(1))
    return np.concatenate([singles, *pairs]), np.repeat([False, False, True], [len(singles), *map(len, pairs)])


def meetings(key: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, known: np.ndarray, later: np.ndarray, odd: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes (smaller first) that share a key, are of different components, and that sizes, known tokens and odd sketches let link."""
    order = np.lexsort((n, key))
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(key) else first
    c = comp[order]
    # at most this size may a partner have: the overlap is in what both know
    reach = (100 + percent) * known[order] // percent - n[order]
    if len(key):
        mixed = (np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)) & (np.maximum.reduceat((reach >= n[order]).astype(np.int8), first) > 0)
        keep = mixed[run]
        order, run, reach = order[keep], run[keep], reach[keep]
    size, c, later = n[order], comp[order], later[order]
    # the smaller one of a pair reaches the larger one, both ways
    place = run * (1 << 32)
    upto = np.searchsorted(place + size, place + np.minimum(np.minimum(reach, size * 100 // percent), (1 << 32) - 1), side="right")
    partners = np.where(reach >= size, np.maximum(upto - np.arange(len(size)) - 1, 0), 0)
    total = np.cumsum(partners)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
        i = np.repeat(np.arange(at, to), partners[at:to])
        j = ragged(np.arange(at, to) + 1, partners[at:to])
        good = (c[i] != c[j]) & (size[i] <= reach[j]) & ~(later[i] & later[j])
        i, j = i[good], j[good]
        apart = np.bitwise_count((odd[order[i]] ^ odd[order[j]]).view(U)).sum(axis=1, dtype=np.int64)
        good = (100 + percent) * apart <= (100 - percent) * (size[i] + size[j])
        a, b = node[order[i[good]]], node[order[j[good]]]
        yield np.minimum(a, b), np.maximum(a, b)
        at = to


def _unique_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
    return a[new], b[new]


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``class_id`` (smallest id with the same set) and ``component_id`` (smallest id reachable by links of ``percent`` Jaccard similarity)."""
    source = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = buckets_for(source)

    def sizes(batch: pa.RecordBatch):
        for lo, hi, tokens, ptr in _sets(batch.column(1), shingle):
            n = np.diff(ptr)
            yield pa.RecordBatch.from_arrays([pa.array(rows_of(batch, "doc_id", lo, hi)), pa.array(n), pa.array(_class_of(tokens, ptr), mask=n == 0)], names=["doc_id", "n", "owner"])

    def prefixes(batch: pa.RecordBatch):
        for _, _, tokens, ptr in _sets(batch.column(1), shingle):
            n = np.diff(ptr)
            take = np.minimum(n, n - -(-percent * n // 100) + 1 + n // 20)
            values, owners = tokens[ragged(ptr[:-1], take)], np.repeat(_class_of(tokens, ptr), take)
            order, new, _ = firsts(values, owners)
            v, o = values[order], owners[order]
            told = _shared(v, o)
            flag = {k: x for k, _, x in packets(v[new], told[new].astype(np.int64), buckets)}
            yield packet_rows([(k, a, b, flag[k]) for k, a, b in packets(v[new], o[new], buckets)], tallied(o[told], buckets))

    def count_shared(table: pa.Table) -> list[tuple]:
        values, owners, told = unpack(table["a"]), unpack(table["b"], np.int64), unpack(table["c"], np.int64)
        order = np.lexsort((owners, values))
        shared = _shared(values[order], owners[order]) & (told[order] == 0)
        return tallied(owners[order][shared], buckets)

    def add_up(table: pa.Table) -> pa.Table:
        owners, back = np.unique(unpack(table["b"], np.int64), return_inverse=True)
        return pa.table({"owner": pa.array(owners), "common": pa.array(np.bincount(back, unpack(table["a"], np.int64), len(owners)).astype(np.int64))})

    members = cut(source.mapInArrow(stream(sizes), "doc_id long, n long, owner long"))
    classes = members.where("owner IS NOT NULL").groupBy("owner").agg(F.min("doc_id").alias("class_id"), F.min("n").alias("n"))
    shared = exchange(source.mapInArrow(stream(prefixes), PACKET), count_shared, add_up, "owner long, common long")
    able = cut(shared.join(classes, "owner").where(F.col("common") >= 1 + F.floor(F.col("n") * percent / 100 / 20)).select(F.col("class_id").alias("doc_id"), "n", "owner", "common"))

    def whole(batch: pa.RecordBatch):
        for lo, hi, tokens, ptr in _sets(batch.column(1), shingle):
            n = np.diff(ptr)
            ok = np.flatnonzero((_class_of(tokens, ptr) == rows_of(batch, "owner", lo, hi)) & (n > 0))  # rows of one id with other texts aren't this class
            raw = packed(tokens, ptr)
            odd = [_odd(tokens[ptr[r] : ptr[r + 1]]) for r in ok]
            least = [tokens[ptr[r] : min(ptr[r + 1], ptr[r] + _MINIMA)].view(np.int64) for r in ok]
            central = 1000 * rows_of(batch, "common", lo, hi) // np.maximum(n, 1)
            columns = {"node": rows_of(batch, "doc_id", lo, hi)[ok], "n": n[ok], "central": central[ok], "tokens": [raw[r] for r in ok]}
            types = {"node": pa.int64(), "n": pa.int64(), "central": pa.int64(), "tokens": pa.binary()}
            arrays = [pa.array(columns[k], type=t) for k, t in types.items()] + [pa.array(x, type=pa.list_(pa.int64())) for x in (least, odd)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*types, "least", "odd"])

    chosen = source.join(beside(able), "doc_id").select("doc_id", "text", "owner", "common")
    found = chosen.mapInArrow(stream(whole), "node long, n long, central long, tokens binary, least array<long>, odd array<long>")
    twice = not members.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()  # then a set may have come several times
    sets = cut(found.dropDuplicates(["node"]) if twice else found)

    def overlap(batch: pa.RecordBatch):
        keep = []
        for i, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)):
            both = len(np.intersect1d(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U), assume_unique=True))
            if 100 * both >= percent * (n + m - both):
                keep.append(i)
        yield batch.take(pa.array(keep, type=pa.int64())).select(["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        # only the sets that a pair needs are shuffled
        pairs = beside(cut(pairs, tidy=False))
        left = sets.select(F.col("node").alias("a"), "n", F.col("tokens").alias("x")).join(pairs, "a")
        right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y")).join(pairs, "b")
        return cut(left.join(right, ["a", "b"]).select("a", "b", "n", "m", "x", "y").mapInArrow(stream(overlap), "a long, b long"))

    # the most central class of each smallest hash against the others that have it
    met = sets.select(F.explode("least").alias("key"), "node", "n", "central", "odd")
    middle = met.groupBy("key").agg(F.max(F.struct("central", F.negative("node").alias("before"), "n", "odd")).alias("p"), F.count("*").alias("times")).where("times > 1").select("key", "p")
    apart = F.aggregate(F.zip_with("odd", F.col("p.odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    other = F.negative("p.before")
    pairs = met.join(middle, "key").where((F.col("node") != other) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("p.n"))))
    edges = verify(pairs.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct())
    labels = components(edges)
    named = beside(labels.withColumnRenamed("component", "c"))
    placed = sets.join(named, "node", "left").select("node", "tokens", F.coalesce("c", "node").alias("c"))

    def known_to_others(batch: pa.RecordBatch):
        """Tokens with their class and component, one of each that many classes of the slice have."""
        nodes, comps, raw = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
        n = np.array([len(x) // 8 for x in raw], dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(n) // _TOKENS]))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(n)], strict=True):
            values, at = np.frombuffer(b"".join(raw[lo:hi]), dtype=U), np.repeat(np.arange(lo, hi), n[lo:hi])
            order = np.argsort(values, kind="stable")
            v, at = values[order], at[order]
            new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, dtype=bool)
            run = np.cumsum(new) - 1
            many = (np.bincount(run) >= LOCAL)[run] if len(v) else new
            told = [(k, a, b, np.full(len(a) // 8, _FREQUENT, dtype=np.int64).tobytes()) for k, a, b in by_home(v[many], nodes[at[many]], buckets)]
            out = ~many | new
            sent, own = [], comps[at] == nodes[at]  # then the owner says it all
            for alone in (True, False):
                use = out & ((own & ~many) == alone)
                comp = {k: x for k, _, x in packets(v[use], np.where(many, -1, comps[at])[use], buckets)}
                sent += [(k, a, b, None if alone else comp[k]) for k, a, b in packets(v[use], nodes[at[use]], buckets)]
            yield packet_rows(sent, told)

    def count(table: pa.Table) -> list[tuple]:
        values, owners = unpack(table["a"]), unpack(table["b"], np.int64)
        comps = np.frombuffer(b"".join(b if c is None else c for b, c in zip(table["b"].to_pylist(), table["c"].to_pylist(), strict=True)), dtype=np.int64)
        order = np.lexsort((comps, values))
        values, owners, comps = values[order], owners[order], comps[order]
        new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, dtype=bool)
        start, run = np.flatnonzero(new), np.cumsum(new) - 1
        df = np.add.reduceat((new | np.r_[True, comps[1:] != comps[:-1]]).astype(np.int64), start) if len(values) else start
        df = np.where((df > RARE) | (comps[start] == -1), _FREQUENT, df)[run]
        known = (df > 1) & (comps != -1)
        return [(k, a, b, c) for (k, a, b), (_, c, _) in zip(by_home(values[known], owners[known], buckets), by_home(df[known].astype(U), owners[known], buckets), strict=True)]

    def gather(table: pa.Table) -> pa.Table:
        values, owners, df = unpack(table["a"]), unpack(table["b"], np.int64), unpack(table["c"])
        a, b = by_owner(values, owners), by_owner(df, owners)
        return pa.table({"node": pa.array([x[0] for x in a], type=pa.int64()), "tokens": pa.array([x[1] for x in a], type=pa.binary()), "df": pa.array([x[1] for x in b], type=pa.binary())})

    known = exchange(placed.mapInArrow(stream(known_to_others), PACKET), count, gather, "node long, tokens binary, df binary")

    def index(batch: pa.RecordBatch):
        keys, rows, details = [], [], []
        for node, n, c, odd, tokens, df in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            tokens, df = np.frombuffer(tokens, dtype=U), np.frombuffer(df, dtype=np.int64)
            if len(tokens) < _share(n, percent):
                continue
            key, later = index_keys(n, tokens, df, percent)
            keys.append(key)
            rows.append(len(details) + later)
            details += [[node, c, n, len(tokens), x, *odd] for x in (0, 1)]
        key, row = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, rows))
        order = np.argsort(key, kind="stable")
        key, row = key[order].astype(U), row[order]
        table = np.array(details, dtype=np.int64).reshape(-1, 5 + _ODD)
        bucket = (((key >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        parts = [(int(bucket[x]), key[x:y].tobytes(), np.ascontiguousarray(table[row[x:y]]).tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], type=pa.int32()), *(pa.array([x[i] for x in parts], type=pa.binary()) for i in (1, 2))], names=["bucket", "a", "b"])

    def meet(table: pa.Table) -> pa.Table:
        key, rest = unpack(table["a"]), unpack(table["b"], np.int64).reshape(-1, 5 + _ODD)
        a, b = _unique_pairs(list(meetings(key, *(rest[:, i] for i in range(4)), rest[:, 4] > 0, rest[:, 5:], percent)))
        parts = by_home(b.view(U), a, buckets)
        return pa.table({"bucket": pa.array([x[0] for x in parts], type=pa.int32()), **{k: pa.array([x[i] for x in parts], type=pa.binary()) for k, i in (("a", 2), ("b", 1))}})

    def distinct_pairs(table: pa.Table) -> pa.Table:
        """A pair meets in many keys: one of each stays."""
        a, b = _unique_pairs([(unpack(table["a"], np.int64), unpack(table["b"], np.int64))])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    told = sets.select("node", "n", "odd").join(named, "node", "left").withColumn("c", F.coalesce("c", "node"))
    postings = known.join(told, "node").select("node", "n", "c", "odd", "tokens", "df").mapInArrow(stream(index), "bucket int, a binary, b binary")
    met = postings.groupBy("bucket").applyInArrow(per_group(meet), "bucket int, a binary, b binary").groupBy("bucket").applyInArrow(per_group(distinct_pairs), "a long, b long")
    more = verify(met)
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    named = members.join(classes.select("owner", "class_id"), "owner", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    named = named.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _shared(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which of the pairs, ordered by both, have a value that several owners hold."""
    if not len(values):
        return np.zeros(0, dtype=bool)
    new = np.r_[True, values[1:] != values[:-1]]
    start = np.flatnonzero(new)
    return (owners[start] != owners[np.append(start[1:], len(values)) - 1])[np.cumsum(new) - 1]


def keep_one(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """The documents (all their columns) with the smallest id of their group."""
    kept = near_duplicates(docs, percent, shingle).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edge AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.doc_id WHERE reach.r < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL
"""
