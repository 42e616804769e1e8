"""Properties of orders, merges and partitioned layouts."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import ArraySchema
from gridloom.operators import fragments, select, tiles
from gridloom.sources.generate import skewed, uniform

S = ArraySchema("a", (("i", -8, 55), ("j", -8, 55)), (("v", "int"),), "int64_t", "hilbert", None, 7)


def cells(spark, n=150, seed=4):
    rng = random.Random(seed)
    places = {(rng.randrange(-8, 56), rng.randrange(-8, 56)) for _ in range(n)}
    return spark.createDataFrame([(i, j, k) for k, (i, j) in enumerate(sorted(places))], "i long, j long, v int")


@pytest.mark.parametrize("order", ["hilbert", "row-major", "column-major"])
def test_rank_is_a_permutation_in_order(spark, order):
    s, df = S.clone("b", order=order), cells(spark)
    ranked = tiles.global_rank(df, s, 5)
    assert sorted(r.rank for r in ranked.collect()) == list(range(df.count()))
    index = tiles.tile_index(tiles.irregular_tiles(df, s), s)
    assert {r.cells for r in index.where(F.col("tile_id") < index.count() - 1).collect()} == {7}


def test_ranges_intersect(spark):
    df = cells(spark)
    twice = select.subarray(select.subarray(df, S, [0, 30, 0, 40]), S, [10, 50, -5, 20])
    assert sorted(twice.collect()) == sorted(select.subarray(df, S, [10, 30, 0, 20]).collect())


def test_merge_is_idempotent_and_any_grouping_gives_the_live_view(spark):
    rng, batches = random.Random(9), []
    for seq in range(5):
        rows = [(i, 0, None if rng.random() < 0.3 else rng.randrange(99)) for i in rng.sample(range(20), 10)]
        batches.append(spark.createDataFrame([(i, j, v, seq, v is None) for i, j, v in rows], "i long, j long, v int, _seq int, _deleted boolean"))
    whole = sorted(fragments.live_view(fragments.union(batches), S).collect())
    part = fragments.merge(fragments.union(batches[1:4]), S, purge=False)
    assert sorted(fragments.live_view(fragments.union([batches[0], part, batches[4]]), S).collect()) == whole
    assert sorted(fragments.merge(part, S, purge=False).collect()) == sorted(part.collect())


def test_nearest_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1, 0, 1), (-1, 0, 2), (0, 1, 3), (0, -1, 4)], "i long, j long, v int")
    found = select.nearest(df, S.clone("r", order="row-major"), [0, 0], 2).collect()
    assert [(r.i, r.j, r.dist2) for r in found] == [(-1, 0, 1.0), (0, -1, 1.0)]


def test_partition_bounds_and_receivers(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1).alias("v"))
    s = ArraySchema("r", (("i", 0, 999), ("j", 0, 0)), (("v", "int"),))
    bounds = [r.bound for r in tiles.partition_bounds(df, s, 4).orderBy("part").collect()]
    sizes = df.groupBy(tiles.receiver(F.col("i"), bounds).alias("p")).count().collect()
    assert len(sizes) == 4 and all(200 <= r["count"] <= 300 for r in sizes)


def test_scans_are_pruned_and_filters_pushed(spark, tmp_path):
    cells(spark).withColumn("w", F.lit(1)).write.parquet(str(tmp_path / "p"))
    plan = select.subarray(spark.read.parquet(str(tmp_path / "p")).select("i", "j", "v"), S, [0, 9, 0, 9])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(i,0)" in plan and "w" not in plan.split("ReadSchema")[-1]


def test_generators(spark):
    assert uniform(spark, 100, lo=5, hi=6).agg(F.min("c0"), F.max("c3")).first()[:] == (5, 6)
    assert skewed(spark, 500).agg(F.avg("c0")).first()[0] < 400_000
    assert tiles.sample_cells(uniform(spark, 100), 10).count() == 10
