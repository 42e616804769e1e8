"""The array operators over the driver's tables, and SQL that gives the same rows.

Views: orders is an array over (o_custkey, o_orderkey), unique in both; its
order date, as days, and total price in cents are attributes.  lineitem serves
operators that look at one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expressions import parse, predicate, preset
from .functions.ids import ID, cell_id_hilbert, text_hash, tile_id_column_major, tile_id_hilbert, tile_id_row_major, with_order
from .operators import fragments, select, tiles
from .operators.join import join
from .schema import DELETED, SEQ, ArraySchema

ORDERS = ArraySchema("orders", (("o_custkey", 0, 262143), ("o_orderkey", 0, 262143)), (("price", "double"), ("priority", "char")), "int64_t", "row-major")
REGULAR = ORDERS.clone("regular", extents=(100, 1000))
COUNTS = ORDERS.clone("counts", attributes=(("price", "double"), ("lines", "int64_t")))
LINES = ArraySchema("lines", (("l_orderkey", 0, 1 << 40), ("l_linenumber", 0, 100)), (("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double")))
EVENTS = ArraySchema("events", (("event_id", 0, 1 << 40),), (("user_id", "int64_t"), ("value", "double")))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), F.substring("o_orderpriority", 1, 1).alias("priority"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(*LINES.columns)


def subarray_2d(spark, sf_dir):
    return select.subarray(orders(spark, sf_dir), ORDERS, [100, 900, 2000, 9000])


def filter_expr(spark, sf_dir):
    return select.filter_cells(lines(spark, sf_dir), LINES, "l_quantity * 2 >= 60 && l_discount < 0.05 || l_extendedprice / l_quantity > 2000")


def filter_compat(spark, sf_dir):
    return select.filter_preset(orders(spark, sf_dir), ORDERS, "price")


def filter_typed_predicate(spark, sf_dir):
    cells = lines(spark, sf_dir)
    return fragments.union([cells.where(predicate("l_quantity", op, 25, LINES)).groupBy(F.lit(op).alias("op")).agg(F.count("*").alias("cells")) for op in ("LT", "LE", "EQ", "GE", "GT", "NE")])


EXPRESSIONS = {
    "added": "l_quantity + l_tax", "less": "l_quantity - l_discount", "times": "l_quantity * l_extendedprice", "ratio": "l_extendedprice / l_quantity", "rest": "l_quantity % 7",
    "gt": "l_quantity > 25", "lt": "l_quantity < 25", "eq": "l_quantity == 25", "ge": "l_quantity >= 25", "le": "l_quantity <= 25", "both": "l_quantity > 10 && l_discount", "either": "l_quantity > 40 || l_tax",
}


def expr_arith(spark, sf_dir):
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", *[parse(text, LINES).value.alias(name) for name, text in EXPRESSIONS.items()])


def array_join(spark, sf_dir):
    counts = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    other = _read(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", (F.col("o_totalprice") * 2).alias("price"), "lines")
    return join(orders(spark, sf_dir), ORDERS, other, COUNTS)[0]


def knn_2d(spark, sf_dir):
    return select.nearest(orders(spark, sf_dir), ORDERS, [700, 5000], 25)


def knn_embedding(spark, sf_dir):
    point = [(i % 7 - 3) / 8 for i in range(64)]
    return select.nearest_vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", point, 10).select("vec_id")


def tile_id_row(spark, sf_dir):
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", tile_id_row_major(REGULAR).alias("tile_id"))


def tile_id_col(spark, sf_dir):
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", tile_id_column_major(REGULAR).alias("tile_id"))


def _hilbert(spark, sf_dir, make, schema):
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", make(schema).alias("id"))


def tile_hilbert(spark, sf_dir):
    return _hilbert(spark, sf_dir, tile_id_hilbert, REGULAR.clone("h", order="hilbert"))


def cell_hilbert(spark, sf_dir):
    return _hilbert(spark, sf_dir, cell_id_hilbert, ORDERS.clone("h", order="hilbert"))


def tile_mbr(spark, sf_dir):
    return tiles.tile_index(tiles.tiled(orders(spark, sf_dir), REGULAR), REGULAR)


def tile_pruning(spark, sf_dir):
    return select.overlapping_tiles(tile_mbr(spark, sf_dir), REGULAR, [100, 900, 2000, 9000]).select("tile_id", "cells", "full")


def tile_mindist(spark, sf_dir):
    return select.tile_distance(tile_mbr(spark, sf_dir), REGULAR, [700, 5000]).select("tile_id", F.col("mindist2"))


def tile_bounds(spark, sf_dir):
    return tiles.bounding_cells(tiles.tiled(orders(spark, sf_dir), REGULAR), REGULAR).select("tile_id", F.col("first.o_custkey").alias("first_cust"), F.col("first.o_orderkey").alias("first_order"), F.col("last.o_custkey").alias("last_cust"), F.col("last.o_orderkey").alias("last_order"))


def irregular_tiles(spark, sf_dir):
    s = ORDERS.clone("i", capacity=500)
    return tiles.irregular_tiles(orders(spark, sf_dir), s).select("o_custkey", "o_orderkey", "tile_id")


def retile_capacity(spark, sf_dir):
    s = ORDERS.clone("i", capacity=1250)
    return tiles.tile_index(tiles.irregular_tiles(orders(spark, sf_dir), s), s)


def export_order(spark, sf_dir):
    return tiles.global_rank(orders(spark, sf_dir), ORDERS.clone("c", order="column-major")).select("o_custkey", "o_orderkey", "rank")


def regular_order(spark, sf_dir):
    return tiles.global_rank(orders(spark, sf_dir), REGULAR).select("o_custkey", "o_orderkey", "rank")


def _batches(spark, sf_dir) -> DataFrame:
    """Three batches: all orders; every third with another price; every fifth deleted and every seventh of those there again."""
    first = orders(spark, sf_dir).select(*ORDERS.columns, F.lit(0).alias(SEQ), F.lit(False).alias(DELETED))
    second = first.where("o_orderkey % 3 = 0").withColumns({"price": F.col("price") + 1000, SEQ: F.lit(1), DELETED: F.col("o_orderkey") % 5 == 0})
    third = first.where("o_orderkey % 7 = 0").withColumns({"price": F.col("price") + 5000, SEQ: F.lit(2)})
    return fragments.union([first, second, third])


def live_view(spark, sf_dir):
    return fragments.live_view(_batches(spark, sf_dir), ORDERS)


def update_delete(spark, sf_dir):
    return fragments.live_view(_batches(spark, sf_dir).where(F.col(SEQ) < 2), ORDERS)


def consolidate_partial(spark, sf_dir):
    return fragments.merge(_batches(spark, sf_dir).where(F.col(SEQ) > 0), ORDERS, purge=False).select(*ORDERS.columns, F.col(SEQ).alias("seq"), F.col(DELETED).alias("deleted"))


def consolidate_full(spark, sf_dir):
    return fragments.merge(_batches(spark, sf_dir), ORDERS, purge=True).select(*ORDERS.columns, F.col(SEQ).alias("seq"))


def aggregate_max(spark, sf_dir):
    return select.aggregate_max(orders(spark, sf_dir), ORDERS, "price")


def hash_load(spark, sf_dir):
    return tiles.hash_partitioned(orders(spark, sf_dir), ORDERS, 8)


def ordered_load(spark, sf_dir):
    return tiles.range_partitioned(orders(spark, sf_dir), ORDERS, 8)


def range_partition_bounds(spark, sf_dir):
    """Each bound's number, whether it is above the one before, and whether about its share of the cells is at or below it."""
    cells = orders(spark, sf_dir)
    bounds = tiles.partition_bounds(cells, ORDERS, 8).withColumn("rises", F.col("bound") > F.coalesce(F.lag("bound").over(Window.orderBy("part")), F.lit(-1)))
    below = cells.join(F.broadcast(bounds), F.col("o_custkey") <= F.col("bound")).groupBy("part", "rises").agg(F.count("*").alias("below"))
    return below.select(F.col("part").cast("long").alias("part"), "rises", F.abs(F.col("below") / cells.count() - (F.col("part") + 1) / 8).between(0, 0.02).alias("its_share"))


def copartitioned_join(spark, sf_dir):
    a = tiles.hash_partitioned(orders(spark, sf_dir), ORDERS, 8)
    b = tiles.hash_partitioned(orders(spark, sf_dir).withColumn("price", F.col("price") * 2), ORDERS, 8)
    return join(a, ORDERS, b, ORDERS)[0]


def coordinate_hash(spark, sf_dir):
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", text_hash(F.concat_ws(",", "o_custkey", "o_orderkey")).alias("hash"))


def events_1d(spark, sf_dir):
    return select.filter_cells(select.subarray(_read(spark, sf_dir, "events").select(*EVENTS.columns), EVENTS, [0, 1 << 40]), EVENTS, "value > 50")


def cell_order(spark, sf_dir):
    """Each cell's place among its customer's, by the global order of a Hilbert array."""
    df, keys = with_order(orders(spark, sf_dir), ORDERS.clone("h", order="hilbert"))
    return df.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(*keys)).alias("first"), F.count(ID).alias("cells"))


QUERIES = {f.__name__: f for f in (
    subarray_2d, filter_expr, filter_compat, filter_typed_predicate, expr_arith, array_join, knn_2d, knn_embedding, tile_id_row, tile_id_col, tile_hilbert, cell_hilbert, tile_mbr, tile_pruning, tile_mindist, tile_bounds,
    irregular_tiles, retile_capacity, export_order, regular_order, live_view, update_delete, consolidate_partial, consolidate_full, aggregate_max, hash_load, ordered_load, range_partition_bounds, copartitioned_join, coordinate_hash, events_1d, cell_order,
)}

_O = "(SELECT o_custkey, o_orderkey, o_totalprice AS price, substr(o_orderpriority, 1, 1) AS priority FROM orders)"
_T = "CAST(floor(o_custkey / 100) AS BIGINT)", "CAST(floor(o_orderkey / 1000) AS BIGINT)"
_ROWS, _COLS = 2622, 263
_ROW_ID, _COL_ID = f"{_T[0]} + {_T[1]} * {_ROWS}", f"{_T[1]} + {_T[0]} * {_COLS}"
_MBR = f"SELECT {_ROW_ID} AS tile_id, count(*) AS cells, min(o_custkey) AS o_custkey_min, max(o_custkey) AS o_custkey_max, min(o_orderkey) AS o_orderkey_min, max(o_orderkey) AS o_orderkey_max FROM {_O} GROUP BY 1"
_BATCHES = f"""(SELECT *, 0 AS seq, false AS deleted FROM {_O}
UNION ALL SELECT o_custkey, o_orderkey, price + 1000, priority, 1, o_orderkey % 5 = 0 FROM {_O} WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_custkey, o_orderkey, price + 5000, priority, 2, false FROM {_O} WHERE o_orderkey % 7 = 0)"""


def _latest(where: str, columns: str, test: str = "true") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY seq DESC) AS v FROM {_BATCHES} WHERE {where}) WHERE v = 1 AND {test}"


def _hilbert_sql(x: str, y: str, bits: int) -> str:
    """The two-dimensional curve by a fold over bits, with the quadrant's turn as state."""
    return f"""WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, CAST({bits - 1} AS BIGINT) AS b, CAST(0 AS BIGINT) AS id FROM {_O}
UNION ALL
SELECT o_custkey, o_orderkey,
  CASE WHEN (y >> b) & 1 = 1 THEN x WHEN (x >> b) & 1 = 1 THEN (1 << b) - 1 - (y & ((1 << b) - 1)) ELSE y END & ((1 << b) - 1),
  CASE WHEN (y >> b) & 1 = 1 THEN y WHEN (x >> b) & 1 = 1 THEN (1 << b) - 1 - (x & ((1 << b) - 1)) ELSE x END & ((1 << b) - 1),
  b - 1, id * 4 + xor(3 * ((x >> b) & 1), (y >> b) & 1)
FROM c WHERE b >= 0)
SELECT o_custkey, o_orderkey, id FROM c WHERE b = -1"""


_E = {"added": "l_quantity + l_tax", "less": "l_quantity - l_discount", "times": "l_quantity * l_extendedprice", "ratio": "l_extendedprice / l_quantity", "rest": "CAST(CAST(trunc(l_quantity) AS BIGINT) % 7 AS DOUBLE)"}
_E |= {k: f"CAST(l_quantity {op} 25 AS DOUBLE)" for k, op in (("gt", ">"), ("lt", "<"), ("eq", "="), ("ge", ">="), ("le", "<="))}
_E |= {"both": "CAST(l_quantity > 10 AND l_discount <> 0 AS DOUBLE)", "either": "CAST(l_quantity > 40 OR l_tax <> 0 AS DOUBLE)"}
_POINT = "[" + ", ".join(str((i % 7 - 3) / 8) for i in range(64)) + "]"

ORACLE = {
    "subarray_2d": f"SELECT * FROM {_O} WHERE o_custkey BETWEEN 100 AND 900 AND o_orderkey BETWEEN 2000 AND 9000",
    "filter_expr": f"SELECT {', '.join(LINES.columns)} FROM lineitem WHERE l_quantity * 2 >= 60 AND l_discount < 0.05 OR l_extendedprice / l_quantity > 2000",
    "filter_compat": f"SELECT * FROM {_O} WHERE price BETWEEN 250000 AND 300000",
    "filter_typed_predicate": " UNION ALL ".join(f"SELECT '{k}' AS op, count(*) AS cells FROM lineitem WHERE l_quantity {op} 25" for k, op in (("LT", "<"), ("LE", "<="), ("EQ", "="), ("GE", ">="), ("GT", ">"), ("NE", "<>"))),
    "expr_arith": f"SELECT l_orderkey, l_linenumber, l_quantity, {', '.join(f'{v} AS {k}' for k, v in _E.items())} FROM lineitem",
    "array_join": f"SELECT a.*, o_totalprice * 2 AS price_2, lines FROM {_O} a JOIN orders o USING (o_custkey, o_orderkey) JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = a.o_orderkey",
    "knn_2d": f"SELECT *, CAST((o_custkey - 700) * (o_custkey - 700) + (o_orderkey - 5000) * (o_orderkey - 5000) AS DOUBLE) AS dist2 FROM {_O} ORDER BY dist2, o_custkey, o_orderkey LIMIT 25",
    "knn_embedding": f"SELECT vec_id FROM (SELECT vec_id, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST({_POINT} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10",
    "tile_id_row": f"SELECT o_custkey, o_orderkey, {_ROW_ID} AS tile_id FROM {_O}",
    "tile_id_col": f"SELECT o_custkey, o_orderkey, {_COL_ID} AS tile_id FROM {_O}",
    "tile_mbr": _MBR,
    "tile_pruning": f"SELECT tile_id, cells, o_custkey_min >= 100 AND o_custkey_max <= 900 AND o_orderkey_min >= 2000 AND o_orderkey_max <= 9000 AS \"full\" FROM ({_MBR}) WHERE o_custkey_min <= 900 AND o_custkey_max >= 100 AND o_orderkey_min <= 9000 AND o_orderkey_max >= 2000",
    "tile_mindist": f"SELECT tile_id, CAST(pow(greatest(o_custkey_min - 700, 700 - o_custkey_max, 0), 2) + pow(greatest(o_orderkey_min - 5000, 5000 - o_orderkey_max, 0), 2) AS DOUBLE) AS mindist2 FROM ({_MBR})",
    "tile_bounds": f"SELECT t AS tile_id, arg_min(o_custkey, o) AS first_cust, arg_min(o_orderkey, o) AS first_order, arg_max(o_custkey, o) AS last_cust, arg_max(o_orderkey, o) AS last_order FROM (SELECT *, {_ROW_ID} AS t, o_custkey * 1000000 + o_orderkey AS o FROM {_O}) GROUP BY 1",
    "irregular_tiles": f"SELECT o_custkey, o_orderkey, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 500 AS tile_id FROM {_O}",
    "retile_capacity": f"SELECT tile_id, count(*) AS cells, min(o_custkey) AS o_custkey_min, max(o_custkey) AS o_custkey_max, min(o_orderkey) AS o_orderkey_min, max(o_orderkey) AS o_orderkey_max FROM (SELECT *, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 1250 AS tile_id FROM {_O}) GROUP BY 1",
    "export_order": f"SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1 AS rank FROM {_O}",
    "regular_order": f"SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY {_ROW_ID}, o_custkey, o_orderkey) - 1 AS rank FROM {_O}",
    "live_view": _latest("true", "o_custkey, o_orderkey, price, priority", "NOT deleted"),
    "update_delete": _latest("seq < 2", "o_custkey, o_orderkey, price, priority", "NOT deleted"),
    "consolidate_partial": _latest("seq > 0", "o_custkey, o_orderkey, price, priority, seq, deleted"),
    "consolidate_full": _latest("true", "o_custkey, o_orderkey, price, priority, seq", "NOT deleted"),
    "aggregate_max": f"SELECT max(price) AS max_price FROM {_O}",
    "hash_load": f"SELECT * FROM {_O}",
    "ordered_load": f"SELECT * FROM {_O}",
    "copartitioned_join": f"SELECT a.*, price * 2 AS price_2, priority AS priority_2 FROM {_O} a",
    "range_partition_bounds": "SELECT part, true AS rises, true AS its_share FROM range(7) AS t(part)",
    "cell_order": f"SELECT o_custkey, arg_min(o_orderkey, id) AS first, count(*) AS cells FROM ({_hilbert_sql('o_custkey', 'o_orderkey', 18)}) GROUP BY 1",
    "coordinate_hash": f"""WITH t AS (SELECT o_custkey, o_orderkey, o_custkey || ',' || o_orderkey AS s FROM {_O})
SELECT o_custkey, o_orderkey, list_reduce(list_prepend(CAST(length(s) AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: xor(xor((h << 5) & 4294967295, h >> 27), c)) AS hash FROM t""",
    "events_1d": "SELECT event_id, user_id, value FROM events WHERE value > 50",
    "tile_hilbert": _hilbert_sql(*_T, 12),
    "cell_hilbert": _hilbert_sql("o_custkey", "o_orderkey", 18),
}
