"""Golden results of small fixtures, for every verb."""

import pytest

from gridloom import ArraySchema, Engine, SchemaError
from gridloom.functions.ids import cell_id_hilbert, tile_id_column_major, tile_id_hilbert, tile_id_row_major
from gridloom.operators import tiles

DIMS = (("i", 0, 100), ("j", 0, 100))
TWO, THREE = (("attr1", "float"), ("attr2", "int")), (("attr1", "float"), ("attr2", "int"), ("attr3", "int"))
CELLS = [(10, 12, 3, 1), (11, 13, 6, 6), (50, 12, 5, 7), (45, 12, 4, 8), (19, 20, 1, 8), (17, 21, 2, 9), (16, 22, 2, 9), (19, 23, 1, 8)]
IDS = {(10, 12): (182, 8, 44, 44), (11, 13): (180, 8, 44, 44), (50, 12): (1524, 72, 52, 212), (45, 12): (1185, 71, 51, 191), (19, 20): (565, 31, 87, 67), (17, 21): (568, 31, 87, 67), (16, 22): (572, 31, 87, 67), (19, 23): (560, 31, 87, 67)}
B = [(11, 13, 2, 6, 6), (16, 22, 7, 2, 9), (45, 12, 4, 4, 8), (50, 12, 3, 5, 7), (1, 1, 1, 1, 1)]
UP1 = [(12, 13, 1, 1), (5, 20, 1, 1), (10, 16, 1, 1), (29, 22, 1, 1), (47, 12, 1, 1), (45, 9, 1, 1), (46, 23, 1, 1), (33, 21, 1, 1), (19, 20, None, None)]
UP2 = [(4, 3, 1, 1), (16, 31, 1, 1), (20, 5, 1, 1), (37, 13, 1, 1), (37, 37, 1, 1), (41, 40, 1, 1), (40, 47, 1, 1), (17, 21, 100, 100)]


def array(name="A", order="hilbert", extents=None, attributes=TWO, capacity=6):
    return ArraySchema(name, DIMS, attributes, "int64_t", order, extents, capacity)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "ws"))


@pytest.fixture
def csv(tmp_path):
    def write(rows, name):
        lines = ["# comment", ""] + [",".join("$" if x is None else str(x) for x in r) for r in rows]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    return write


def coordinates(rows):
    return [(r.i, r.j) for r in rows]


@pytest.fixture
def loaded(engine, csv):
    def make(name="A", rows=CELLS, **schema):
        engine.define_array(array(name, **schema))
        engine.load(name, csv(rows, f"{name}.csv"))
        return name

    return make


def test_ids(spark):
    s, r = array(), array(extents=(5, 5))
    df = spark.createDataFrame([c[:2] for c in CELLS], "i long, j long")
    for jvm in (False, True):
        rows = df.select("i", "j", cell_id_hilbert(s, in_jvm=jvm).alias("c"), tile_id_hilbert(r, in_jvm=jvm).alias("h"), tile_id_row_major(r).alias("r"), tile_id_column_major(r).alias("k")).collect()
        assert {(x.i, x.j): (x.c, x.h, x.r, x.k) for x in rows} == IDS


@pytest.mark.parametrize(
    ("order", "extents", "expected"),
    [
        ("row-major", None, [(10, 12), (11, 13), (16, 22), (17, 21), (19, 20), (19, 23), (45, 12), (50, 12)]),
        ("column-major", None, [(10, 12), (45, 12), (50, 12), (11, 13), (19, 20), (17, 21), (16, 22), (19, 23)]),
        ("hilbert", None, [(11, 13), (10, 12), (19, 23), (19, 20), (17, 21), (16, 22), (45, 12), (50, 12)]),
        ("hilbert", (5, 5), [(10, 12), (11, 13), (16, 22), (17, 21), (19, 20), (19, 23), (45, 12), (50, 12)]),
        ("row-major", (5, 5), [(10, 12), (11, 13), (45, 12), (50, 12), (16, 22), (17, 21), (19, 20), (19, 23)]),
        ("column-major", (5, 5), [(10, 12), (11, 13), (16, 22), (17, 21), (19, 20), (19, 23), (45, 12), (50, 12)]),
    ],
)
def test_export_order(engine, loaded, tmp_path, order, extents, expected):
    loaded(order=order, extents=extents)
    assert coordinates(engine.get("A")) == expected
    engine.export_to_csv("A", str(tmp_path / "out"), one_file=True, short=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert [tuple(map(int, x.split(",")[:2])) for x in part.read_text().split()] == expected


def test_subarray_filter_join(engine, loaded):
    loaded()
    loaded("B", B, attributes=THREE)
    assert {tuple(r) for r in engine.subarray("A", [10, 20, 21, 22]).collect()} == {(17, 21, 2, 9), (16, 22, 2, 9)}
    assert set(coordinates(engine.filter("A", "attr2 >= 8").collect())) == {(19, 23), (19, 20), (17, 21), (16, 22), (45, 12)}
    assert set(coordinates(engine.filter("A", "attr1 % 2 == 0 && attr2 < 9").collect())) == {(11, 13), (45, 12)}
    assert engine.filter_preset("A", "attr1").count() == 0
    assert set(coordinates(engine.filter_predicate("A", "attr2", "GE", 9).collect())) == {(17, 21), (16, 22)}
    stored = engine.join("A", "B", "C")
    assert stored.columns == ["i", "j", "attr1", "attr2", "attr1_2", "attr2_2", "attr3"]
    assert [tuple(r) for r in engine.get("C")] == [(11, 13, 6, 6, 2, 6, 6), (16, 22, 2, 9, 7, 2, 9), (45, 12, 4, 8, 4, 4, 8), (50, 12, 5, 7, 3, 5, 7)]
    with pytest.raises(SchemaError):
        engine.join("A", "B", "C")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_updates_and_consolidation(engine, csv, step):
    engine.define_array(array(), step)
    engine.load("A", csv(CELLS, "a.csv"))
    engine.update("A", csv(UP1, "u1.csv"))
    after_one = [(12, 13), (11, 13), (10, 12), (5, 20), (10, 16), (19, 23), (17, 21), (16, 22), (29, 22), (45, 12), (47, 12), (45, 9), (50, 12), (46, 23), (33, 21)]
    assert coordinates(engine.get("A")) == after_one
    engine.update("A", csv(UP2, "u2.csv"))
    rows = list(engine.get("A"))
    assert len(rows) == 22 and (19, 20) not in coordinates(rows)
    assert [tuple(r) for r in rows if (r.i, r.j) == (17, 21)] == [(17, 21, 100, 100)]
    assert [f.name for f in engine.catalog.manifest("A").fragments] == {1: ["0_2"], 2: ["0_1", "2_2"], 3: ["0_2"], 4: ["0_0", "1_1", "2_2"]}[step]
    near = engine.nearest_neighbors("A", [10, 10], 3)
    assert set(coordinates(near.collect())) == {(10, 12), (11, 13), (12, 13)}
    assert engine.aggregate_max("A", "attr2").first()[0] == 100


def test_partial_merge_keeps_deletions(engine, csv):
    engine.define_array(array(), 9)
    engine.load("A", csv(CELLS, "a.csv"))
    engine.update("A", csv(UP1, "u1.csv"))
    engine.update("A", csv(UP2, "u2.csv"))
    before = list(engine.get("A"))
    engine.consolidate("A", 2)
    manifest = engine.catalog.manifest("A")
    assert [f.name for f in manifest.fragments] == ["0_0", "1_2"]
    merged = engine._batches(engine.schema("A"), manifest.fragments[1:])
    assert (merged.count(), merged.where("_deleted").count()) == (17, 1)
    assert list(engine.get("A")) == before
    engine.consolidate("A")
    assert list(engine.get("A")) == before


def test_many_updates_keep_the_tree_sound(engine, csv):
    engine.define_array(array(), 3)
    engine.load("A", csv(CELLS, "a.csv"))
    for n in range(1, 14):
        engine.update("A", csv([(n, n, n, n)], f"u{n}.csv"))
    parts = engine.catalog.manifest("A").fragments
    assert [f.name for f in parts] == ["0_8", "9_11", "12_12", "13_13"]
    assert engine.cells("A").count() == len(CELLS) + 13


def test_tiles_and_retile(engine, loaded):
    loaded()
    boxes = lambda: {r.tile_id: (r.cells, r.i_min, r.i_max, r.j_min, r.j_max) for r in engine.tiles("A").collect()}
    assert boxes() == {0: (6, 10, 19, 12, 23), 1: (2, 45, 50, 12, 12)}
    engine.retile("A", capacity=4)
    assert boxes() == {0: (4, 10, 19, 12, 23), 1: (4, 16, 50, 12, 22)}
    engine.retile("A", capacity=100)
    assert boxes() == {0: (8, 10, 50, 12, 23)}
    engine.retile("A", order="row-major")
    assert coordinates(engine.get("A"))[0] == (10, 12)
    engine.retile("A", extents=(5, 5), order="hilbert")
    assert set(boxes()) == {8, 31, 71, 72}
    engine.retile("A", extents=())
    assert coordinates(engine.get("A"))[0] == (11, 13)


def test_bounding_cells(spark):
    s = array()
    cells = spark.createDataFrame([(i, j, float(x), y) for i, j, x, y in CELLS], "i long, j long, attr1 float, attr2 int")
    found = {r.tile_id: (tuple(r["first"]), tuple(r["last"])) for r in tiles.bounding_cells(tiles.irregular_tiles(cells, s), s).collect()}
    assert found == {0: ((11, 13), (16, 22)), 1: ((45, 12), (50, 12))}


def test_partitioned_loads(engine, csv):
    for how in ("hash", "ordered"):
        engine.define_array(array(how))
        engine.load_partitioned(how, csv(CELLS, "a.csv"), 3, how)
        assert engine.catalog.manifest(how).partitioning == {"how": how, "partitions": 3}
    assert list(engine.get("hash")) == list(engine.get("ordered"))
    assert engine.join("hash", "ordered").count() == len(CELLS)


def test_catalog_rules(engine, loaded, csv):
    with pytest.raises(SchemaError):
        engine.load("A", "nowhere.csv")
    loaded()
    for bad in (lambda: engine.define_array(array()), lambda: engine.load("A", csv(CELLS, "b.csv")), lambda: engine.subarray("A", [1, 2]), lambda: engine.filter("A", "i > 3"), lambda: engine.retile("A"), lambda: engine.nearest_neighbors("A", [1, 1], 0)):
        with pytest.raises(SchemaError):
            bad()
    engine.clear_array("A")
    assert engine.array_defined("A") and not engine.array_loaded("A")
    engine.load("A", csv([*CELLS, (10, 12, 9, 9)], "c.csv"))
    assert [tuple(r) for r in engine.subarray("A", [10, 10, 12, 12]).collect()] == [(10, 12, 9, 9)]
    engine.delete_array("A")
    assert not engine.array_defined("A")


def test_cells_outside_the_domain_fail(engine, csv):
    engine.define_array(array())
    with pytest.raises(Exception, match="no cell of this array"):
        engine.load("A", csv([(101, 0, 1, 1)], "a.csv"))
    assert not engine.array_loaded("A")


def test_partial_nulls_and_extremes_are_values(engine, csv):
    engine.define_array(array())
    engine.load("A", csv([(1, 1, None, 5), (2, 2, 1, 2147483647), (3, 3, None, None)], "a.csv"))
    assert {tuple(r) for r in engine.get("A")} == {(1, 1, None, 5), (2, 2, 1, 2147483647)}


def test_empty_results(engine, loaded):
    loaded(extents=(5, 5))
    assert engine.subarray("A", [90, 95, 90, 95], "E").count() == 0
    assert list(engine.get("E")) == []


def test_stream(engine, loaded, spark, tmp_path):
    from gridloom.streaming.updates import stream_updates

    loaded()
    spark.createDataFrame([(1, 2, 3.0, 4)], "i long, j long, attr1 float, attr2 int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long, attr1 float, attr2 int").parquet(str(tmp_path / "in"))
    stream_updates(engine, "A", stream, str(tmp_path / "cp")).awaitTermination()
    assert (1, 2) in coordinates(engine.get("A"))
    n = engine.catalog.manifest("A").next_seq
    engine.update_cells("A", spark.createDataFrame([(7, 7, 3.0, 4)], "i long, j long, attr1 float, attr2 int"), batch=0)
    assert engine.catalog.manifest("A").next_seq == n


def test_marked_frames_are_checked_too(engine, spark):
    engine.define_array(array())
    frame = lambda rows: spark.createDataFrame(rows, "i long, j long, attr1 double, attr2 long, _deleted boolean")
    with pytest.raises(Exception, match="no cell of this array"):
        engine.load_cells("A", frame([(101, 0, 1.0, 1, False)]))
    engine.load_cells("A", frame([(2, 2, 1.0, 1, False), (2, 2, 5.0, 5, False), (3, 3, 1.0, 1, True), (4, 4, 1.0, 1, None), (5, 5, None, None, False)]).coalesce(1))
    assert {tuple(r) for r in engine.get("A")} == {(2, 2, 5.0, 5), (4, 4, 1.0, 1)}


def test_the_last_file_counts(engine, csv, tmp_path):
    engine.define_array(array())
    big = [(i, j, 0, 0) for i in range(60) for j in range(60)]
    first, second = csv([*big, (1, 1, 111, 1)], "z_large.csv"), csv([(1, 1, 222, 2)], "a_small.csv")
    engine.load("A", [first, second])
    engine.define_array(array("B"))
    engine.load("B", [second, first])
    of = lambda name: [tuple(r) for r in engine.subarray(name, [1, 1, 1, 1]).collect()]
    assert of("A") == [(1, 1, 222, 2)] and of("B") == [(1, 1, 111, 1)]


def test_hash_buckets_join_without_exchange(engine, csv, spark):
    names = ("A", "B")
    for name in names:
        engine.define_array(array(name), 9)
        engine.load_partitioned(name, csv(CELLS, "a.csv"), 3, "hash")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    try:
        assert "Exchange" not in plan(engine.join(*names)) and engine.join(*names).count() == len(CELLS)
        engine.update("A", csv(UP1, "u.csv"))
        engine.consolidate("A")
        assert "Exchange" not in plan(engine.join(*names))
        assert engine.cells("A").count() == 15
        again = Engine(spark, engine.catalog.store.root)  # as another session would read it
        assert "Exchange" not in plan(again.join(*names))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    engine.clear_array("A")
    engine.load_partitioned("A", csv(CELLS[:3], "b.csv"), 2, "hash")
    assert engine.cells("A").count() == 3
    engine.delete_array("A")


def test_states_are_whole_or_not_there(engine, loaded):
    loaded()
    store = engine.catalog.store
    numbers = lambda: sorted(f for f in store.files("A") if f.startswith("state-") and f.endswith(".json"))
    assert len(numbers()) == 2
    last = numbers()[-1]
    store.create("{", "A", "state-99.json.new")  # what a crash while writing leaves
    assert list(engine.get("A")) and numbers()[-1] == last
    assert not store.create("{}", "A", last)
    engine.retile("A", order="row-major", extents=(5, 5))
    assert engine.schema("A").order == "row-major" and len(list(engine.get("A"))) == len(CELLS)


def test_tiles_by_id_and_rank(engine, loaded):
    for order in ("row-major", "column-major", "hilbert"):
        name = order.split("-")[0]
        loaded(name, order=order, extents=(5, 5))
        ids = [r.tile_id for r in engine.tiles(name).orderBy("tile_id").collect()]
        whole = {r.tile_id: set() for r in engine.tiles(name).collect()}
        for r in tiles.tiled(engine.cells(name), engine.schema(name)).collect():
            whole[r.tile_id].add((r.i, r.j))
        assert {t: set(coordinates(engine.tile(name, t).collect())) for t in ids} == whole
        assert set(coordinates(engine.tile_by_rank(name, 1).collect())) == whole[ids[1]]
        assert engine.tile_by_rank(name, 99).count() == 0 and engine.tile(name, -1).count() == 0 and engine.tile(name, 10**6).count() == 0
    loaded("irregular")
    assert engine.tile("irregular", 1).count() == 2


def test_nearest_cells_give_ids_to_few(engine, loaded):
    """The order's ids come after the cut to the k nearest; ties follow the global order."""
    loaded()
    plan = engine.nearest_neighbors("A", [10, 10], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("WindowGroupLimit")  # nearer to the result
    engine.define_array(array("T"))
    engine.load_cells("T", engine.spark.createDataFrame([(5 + x, 5 + y, 1.0, 1) for x, y in ((2, 0), (-2, 0), (0, 2), (0, -2), (1, 1))], "i long, j long, attr1 float, attr2 int"))
    order = coordinates(engine.get("T"))
    found = engine.nearest_neighbors("T", [5, 5], 3).collect()
    ties = [c for c in order if c != (6, 6)]
    assert set(coordinates(found)) == {(6, 6), *ties[:2]}


def test_fractional_bounds_reach_the_scan(engine, loaded):
    loaded()
    found = engine.subarray("A", [15.5, 19.5, 19.5, 22.01])
    assert set(coordinates(found.collect())) == {(16, 22), (17, 21), (19, 20)}
    scan = found._jdf.queryExecution().sparkPlan().toString()
    assert "i#" in scan and ">= 16)" in scan and "cast(i" not in scan
    assert engine.subarray("A", [10.2, 10.8, 0, 100]).count() == 0
