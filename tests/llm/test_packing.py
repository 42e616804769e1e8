import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm.packing import SegmentTokenizer, pack, plan, public_tokenizer
from gridloom.llm.wordbatch import slices

from .conftest import EDGES


def test_segments_give_the_tokenizers_ids():
    texts = [t or "" for t in EDGES] + ["a  b", " a b ", "don't  we're 's é's ü ", "É b", "a b c", "c   d", "<|endoftext|> x <|endoftext|>", " ", " "]
    coder = SegmentTokenizer(public_tokenizer())
    for lo, hi, data, offsets in slices(pa.array(texts)):
        ids, ptr = coder.encode(data, offsets)
        for r in range(hi - lo):
            assert ids[ptr[r] : ptr[r + 1]].tolist() == coder.tokenizer.encode(texts[lo + r], add_special_tokens=False).ids


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = random.Random(3)
    counts: dict[int, int] = {}
    for _ in range(5000):
        n = min(100, int(rng.lognormvariate(3, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    shapes = plan(counts, 100)
    assert all(sum(s) <= 100 for s, _ in shapes)
    used: dict[int, int] = {}
    for shape, times in shapes:
        for x in shape:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(k for _, k in shapes) <= -(-sum(n * k for n, k in counts.items()) // 100) + 2


def test_plan_against_all_combinations():
    """Few pieces of few lengths: the plan ends, uses each piece once, and consumes an exact complement of the longest piece wherever there is one."""
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.randrange(4, 30)
        pieces = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 12))]
        counts = {n: pieces.count(n) for n in pieces}
        left = sorted(pieces)
        for shape, times in plan(counts, capacity):
            for _ in range(times):
                assert max(shape) == max(left) and sum(shape) <= capacity
                rest = list(left)
                rest.remove(max(left))
                exact = any(sum(c) == capacity - max(left) for k in range(4) for c in itertools.combinations(rest, k))
                assert sum(shape) == capacity or not exact
                for x in shape:
                    left.remove(x)
        assert not left


def test_plan_is_exact_where_complements_exist():
    assert plan({7: 3, 3: 3}, 10) == [((7, 3), 3)]
    assert sum(k for _, k in plan({5: 2, 3: 2, 2: 2}, 10)) == 2
    assert sum(k for _, k in plan({4: 1, 3: 1, 2: 1, 1: 1}, 10)) == 1


def test_pack_round_trip(docs):
    texts = [*EDGES, *("some words of text " * n for n in range(1, 40))]
    rows = pack(docs(texts), public_tokenizer(), capacity=64).collect()
    coder = SegmentTokenizer(public_tokenizer()).tokenizer
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids, at = [*coder.encode(t or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            assert k == 0 or r.length == 64
            at += r.length
        assert at == len(ids)
    used: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64
    assert len(used) <= -(-sum(used.values()) // 64) + 2


def test_null_ids_repeated_rows_and_extra_columns(docs):
    texts = ["a b c", "a b c", "no id", None, "tail " * 500]
    frame = docs(texts, [1, 1, None, 2, 3]).withColumn("task", F.lit("x")).withColumn("length", F.lit(None).cast("string"))
    rows = pack(frame, public_tokenizer(), capacity=32).collect()
    one = [r for r in rows if r.doc_id == 1]
    assert {r.doc_id for r in rows} == {1, 2, 3} and len(one) == 2 and one[0].ids_crc32 == one[1].ids_crc32
    assert (one[0].sequence_id, one[0].offset) != (one[1].sequence_id, one[1].offset)
    assert [r.length for r in rows if r.doc_id == 2] == [1]


def test_segments_that_hold_the_mark():
    coder = SegmentTokenizer(public_tokenizer())
    texts = ["x", " <|endoftext|>", " yes", "<|endoftext|><|endoftext|>"]
    ids, n = coder._encode_all(texts)
    assert np.split(ids, np.cumsum(n)[:-1])[1].tolist() == coder.tokenizer.encode(texts[1], add_special_tokens=False).ids
    ids, n = coder._encode_all([f" w{i}" for i in range(777)])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [coder.tokenizer.encode(f" w{i}", add_special_tokens=False).ids for i in range(777)]


def test_empty_table(docs):
    assert pack(docs([]), public_tokenizer()).collect() == []
