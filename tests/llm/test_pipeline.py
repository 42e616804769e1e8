"""The corpus pipeline stage by stage against brute force, on tables with nulls, copies and benchmark passages."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import exchange
from gridloom.llm.line_dedup import edit_distance
from gridloom.llm.packing import SegmentTokenizer, public_tokenizer

from .conftest import EDGES
from .test_pairs import brute_benchmark, brute_jaccard


def tables(spark, folder):
    rng = random.Random(8)
    words = [a + b for a in ("stone", "river", "light", "garden", "winter", "cloud") for b in ("", "s", "ing", "ed", "er")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(14)) for i in range(3)]
    rows, labels = [], []
    for i in range(120):
        good = i % 5 != 0
        t = "\n".join(text(rng.randrange(20, 40)) for _ in range(3)) if good else " ".join(["spam###"] * 40)
        if good and i % 7 == 1:
            t += f"\n{bench[i % 3][1]}"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(good), 0))
        if good and i % 4 == 1:
            rows.append((1000 + i, t.replace("stone ", "stones ", 1), "en", "s0", len(t)))
    rows += [(2000 + i, t, None, None, None) for i, t in enumerate(EDGES)] + [(None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, bench = tables(spark, folder)
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]
    columns = docs.columns

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        return out, {r.doc_id: r for r in out.collect()}

    docs, kept = step("quality", docs)
    assert None not in kept and not any(i % 5 == 0 for i in kept if i < 120)
    assert all(i in kept for i, *_ in rows if i is not None and i < 1200 and i % 5 and i < 1000)
    before = kept
    docs, kept = step("lines", docs)
    for i, r in kept.items():
        left = (r.text or "").split("\n")
        assert [x for x in (before[i].text or "").split("\n") if x in left][: len(left)] == left
        assert r.n_chars == len(r.text or "")
    assert all(i in kept for i in before if i < 1000)
    before = kept
    docs, kept = step("near_duplicates", docs)
    groups = brute_jaccard([(i, r.text) for i, r in before.items()])
    assert set(kept) == {i for i, (_, g) in groups.items() if g == i}
    before = kept
    docs, kept = step("decontaminate", docs)
    hits = brute_benchmark([(i, r.text) for i, r in before.items()], bench, 10)
    assert set(kept) == {i for i, (_, n, _) in hits.items() if not n} and len(kept) < len(before)
    pieces = stages["pack"](spark, docs, folder).collect()
    coder = SegmentTokenizer(public_tokenizer()).tokenizer
    assert {p.doc_id for p in pieces} == set(kept)
    for p in pieces:
        ids = [*coder.encode(kept[p.doc_id].text or "", add_special_tokens=False).ids, 0][p.start : p.start + p.length]
        assert zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == p.ids_crc32


def test_run_gives_what_the_stages_give(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, docs.collect()))


def brute_lines(rows):
    """Texts by id once repeated lines are gone: every pair of distinct normalised lines is compared."""
    normal = lambda x: " ".join(re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[0-9]", "0", x.lower())))
    distinct = sorted({normal(x) for _, t in rows for x in t.split("\n")} - {""})
    group = {x: x for x in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            d = int(0.15 * max(len(a), len(b)) + 1e-9)
            if group[a] != group[b] and abs(len(a) - len(b)) <= d and edit_distance(a, b) <= d:
                old, new = group[a], group[b]
                group = {x: new if g == old else g for x, g in group.items()}
    seen, out = set(), {}
    for i, t in sorted(rows):
        kept = []
        for x in t.split("\n"):
            g = group.get(normal(x))
            if g is None or g not in seen:
                kept.append(x)
            seen.add(g)
        out[i] = "\n".join(kept)
    return out


def test_lines_against_brute_force(spark):
    """Near copies of documents, each with one changed line: no fragment of them may be left."""
    rng = random.Random(12)
    part = ["on", "er", "th", "ing", "ka", "lo", "mi", "ze", "ur", "pra", "dis", "bo"]
    words = ["".join(rng.choice(part) for _ in range(rng.randrange(1, 4))) for _ in range(700)]
    rows = []
    for i in range(40):
        text = [" ".join(rng.choice(words) for _ in range(rng.choice([8, 12, 18, 30]))) for _ in range(3)]
        copy = list(text)
        w = copy[i % 3].split(" ")
        at = rng.randrange(len(w))
        w[at] = w[at] + "q" if i % 2 else rng.choice(words)
        copy[i % 3] = " ".join(w)
        rows += [(i, "\n".join(text)), (1000 + i, "\n".join(copy))]
    wanted = {i: t for i, t in brute_lines(rows).items() if t}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3)
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, frame, None).collect()}
    assert kept == {i: (t, len(t)) for i, t in wanted.items()}
    assert sum(i >= 1000 for i in kept) < 5


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame([], schema)
    for name, stage in stages.items():
        out = stage(spark, docs, folder)
        assert out.collect() == [] and (name == "pack" or out.columns == docs.columns)
    rows = [(1, "stone river light garden " * 8, "en", "s", 9), (1, "stone river light garden " * 8, "en", "s", 9), (None, "no id", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("_n_removed", "_n_lines", "_doc", "_verdicts", "node", "score", "component_id", "owner", "hits", "items", "task", "length"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in stages.items():
        out = stage(spark, docs, folder)
        found = out.collect()
        if name == "pack":
            assert sorted(r.doc_id for r in found) == [1, 1, 2, 3]
        else:
            assert out.columns == docs.columns and {2, 3} <= {r.doc_id for r in found}
            assert all(r.node == "x" and r._n_removed == "x" for r in found)
            docs = spark.createDataFrame(found, docs.schema)


def test_workers_give_memory_back_after_each_task_and_group(monkeypatch):
    """Spark keeps Python workers for the next stages, so what they don't give back adds up over the pipeline."""
    calls = []
    monkeypatch.setattr(exchange, "release_memory", lambda: calls.append(1))
    run = exchange.stream(lambda batch: iter([batch, batch]))
    assert list(run(iter([1, 2]))) == [1, 1, 2, 2] and len(calls) == 1
    assert exchange.per_group(lambda table: table + 1)(1) == 2 and len(calls) == 2
    assert list(exchange.per_task(lambda batches: (x for x in batches))(iter([3]))) == [3] and len(calls) == 3
