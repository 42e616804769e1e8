import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import ArraySchema, SchemaError
from gridloom.cli import parse as parse_cli
from gridloom.cli import run
from gridloom.functions.curves import hilbert_axes, hilbert_index
from gridloom.functions.expressions import parse
from gridloom.functions.ids import text_hash
from gridloom.plans.catalog import Fragment, due
from gridloom.schema import require_joinable

S = ArraySchema("a", (("i", 0, 9),), (("x", "double"), ("y", "double")), "int")


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_path_through_all_cells(n, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert (hilbert_axes(index, n, bits) == cells).all()


def test_two_bit_curve():
    path = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (2, 2), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1), (2, 0), (3, 0)]
    assert hilbert_index(np.array(path), 2).tolist() == list(range(16))


@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 2**31 - 1)), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_hilbert_round_trip(cells):
    cells = np.array(cells)
    assert (hilbert_axes(hilbert_index(cells, 31), 2, 31) == cells).all()


def value(spark, text, x, y):
    return spark.createDataFrame([(x, y)], "x double, y double").select(parse(text, S).value).first()[0]


@pytest.mark.parametrize(
    ("text", "x", "y", "expected"),
    [
        ("x + y * 2", 1, 3, 7), ("(x + y) * 2", 1, 3, 8), ("x - y - 1", 5, 2, 2), ("x / y", 1, 0, math.inf), ("x / y", -1, 0, -math.inf), ("x % y", -7.9, 3.2, -1),
        ("x > y", 2, 1, 1), ("x >= y && y < 3", 2, 2, 1), ("x == -2", -2, 0, 1), ("x || y", 0, 0, 0), ("x != y", math.nan, 1, 1), ("x > y", math.nan, 1, 0), ("(x > 1) + (y > 1)", 2, 2, 2), ("x % y", 1, 0, None),
    ],
)
def test_expressions(spark, text, x, y, expected):
    assert value(spark, text, float(x), float(y)) == expected


def test_nan_of_zero_by_zero(spark):
    assert math.isnan(value(spark, "x / y", 0.0, 0.0))


@pytest.mark.parametrize("text", ["", "1 + 2", "i + 1", "-x", "x +", "(x", "x y", "x & y", "!x", "z > 1"])
def test_expressions_refused(text):
    with pytest.raises(SchemaError):
        parse(text, S)


@pytest.mark.parametrize(
    "changes",
    [
        {"name": "a-b"}, {"dims": ()}, {"attributes": ()}, {"attributes": (("x", "int"), ("x", "int"))}, {"attributes": (("i", "int"),)}, {"attributes": (("x", "text"),)}, {"dim_type": "char"},
        {"dims": (("i", 5, 4),)}, {"order": "zigzag"}, {"capacity": 0}, {"extents": (0,)}, {"extents": (11,)}, {"extents": (1, 1)},
    ],
)
def test_schema_rules(changes):
    with pytest.raises(SchemaError):
        ArraySchema(**{"name": "a", "dims": (("i", 0, 9),), "attributes": (("x", "int"),)} | changes)


def test_schema_round_trip():
    s = ArraySchema("a", (("i", -5, 9), ("j", 0, 1)), (("x", "char"),), "double", "hilbert", (3, 1), 7)
    assert ArraySchema.from_json(s.to_json()) == s
    assert "hilbert" in str(s)
    with pytest.raises(SchemaError, match="Domain mismatch"):
        require_joinable(s, s.clone("b", dims=(("i", -4, 9), ("j", 0, 1))))


@given(st.integers(2, 5), st.integers(1, 80))
@settings(max_examples=60, deadline=None)
def test_policy_covers_all_batches(step, n):
    parts: list[Fragment] = []
    for seq in range(n):
        parts.append(Fragment(seq, seq))
        while found := due(parts, step):
            parts = [*parts[: -found[0]], found[1]]
    assert [x for f in parts for x in range(f.lo, f.hi + 1)] == list(range(n))
    assert all(f.hi - f.lo + 1 == step**f.level for f in parts)
    assert len(parts) <= (step - 1) * (1 + int(math.log(n, step) + 1e-9))


def test_text_hash(spark):
    def plain(s):
        h = len(s)
        for c in s.encode():
            h = ((h << 5) & 0xFFFFFFFF) ^ (h >> 27) ^ c
        return h

    words = ["", "1,2", "360000000,180000000", "abcdefghijk"]
    rows = spark.createDataFrame([(w,) for w in words], "s string").select("s", text_hash(F.col("s")).alias("h")).collect()
    assert {r.s: r.h for r in rows} == {w: plain(w) for w in words}


def test_help_of_each_verb(spark):
    from gridloom.cli import OPTIONS, VERBS

    for verb, (required, optional) in VERBS.items():
        text = run(spark, ["-q", "help", verb])
        assert text.startswith(f"{verb}: ") and all(f"--{OPTIONS[x]}" in text for x in required + optional)
    assert "--array-name" in run(spark, ["-q", "help"])


def test_cli(spark, tmp_path):
    ws, data = str(tmp_path / "ws"), tmp_path / "a.csv"
    data.write_text("1,2,3\n4,5,-6\n")
    do = lambda *a: run(spark, [*a, "-w", ws])
    do("-q", "define_array", "-A", "A", "-o", "row-major", "-a", "v", "-d", "i", "-d", "j", "-D", "0", "-D", "9", "-D", "0", "-D", "9", "-t", "int", "-t", "int64_t")
    do("-q", "load", "-A", "A", "-f", str(data))
    do("--query", "filter", "--array-name", "A", "--expression", "v < 0", "--result-name", "N")
    do("-q", "export_to_csv", "-A", "N", "-f", str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*")] == ["4,5,-6\n"]
    for bad in (["-q", "load", "-A", "A"], ["-q", "load", "-A", "A", "-f", "x", "-N", "1"], ["-q", "join", "-A", "A", "-R", "r"], ["-q", "load", "-A", "A", "-f", "x", "-f", "y"]):
        with pytest.raises(SchemaError):
            parse_cli([*bad, "-w", ws])
