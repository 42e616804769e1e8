"""The verbs over a workspace of named arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions.ids import with_order
from .operators import fragments, select, tiles
from .operators.join import join as join_arrays
from .plans.catalog import Catalog, Fragment, Manifest, due
from .schema import DELETED, SEQ, ArraySchema, SchemaError
from .sources.csv import PLACE, checked, in_reading_order, read_csv, with_deletions, write_csv


def _last_of_each(spread: DataFrame, keys: list[Column]) -> DataFrame:
    """Of rows with equal coordinates the last by place; those rows are in one partition and adjacent once it is sorted, so nothing is shuffled."""
    if PLACE not in spread.columns:
        return spread
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(PLACE)))
    return spread.withColumn("_n", last).where("_n = 1").drop("_n", PLACE)


class Engine:
    """Named arrays below a workspace folder.

    A query returns a lazy frame; with ``result`` it is also stored as a new array of that name.  A stored result appears only when its data are complete."""

    def __init__(self, spark: SparkSession, workspace: str):
        self.spark, self.catalog = spark, Catalog(spark, workspace)

    # -- catalog

    def define_array(self, schema: ArraySchema, step: int = 3) -> None:
        """step: batches of one level that consolidation merges; 1 merges after each update."""
        self.catalog.define(schema, step)

    def delete_array(self, name: str) -> None:
        parts = self.catalog.manifest(name).fragments
        self.catalog.delete(name)
        for f in parts:
            self._forget(name, f)

    def clear_array(self, name: str) -> None:
        parts = self.catalog.manifest(name).fragments
        self.catalog.clear(name)
        for f in parts:
            self._forget(name, f)

    def array_defined(self, name: str) -> bool:
        return self.catalog.defined(name)

    def array_loaded(self, name: str) -> bool:
        return self.catalog.loaded(name)

    def schema(self, name: str) -> ArraySchema:
        return self.catalog.schema(name)

    # -- data in

    def load(self, name: str, path: str | list[str]) -> None:
        """CSV as the first batch."""
        schema = self._unloaded(name)
        self._append(schema, read_csv(self.spark, path, schema))

    def load_cells(self, name: str, cells: DataFrame) -> None:
        """Any frame with the array's columns as the first batch; a boolean ``_deleted`` marks cells that aren't there.  Types, domain and equal coordinates are seen to as with CSV."""
        schema = self._unloaded(name)
        self._append(schema, self._prepared(cells, schema))

    def update(self, name: str, path: str | list[str]) -> None:
        """CSV as a further batch: new coordinates insert, others overwrite, a line of nulls deletes."""
        schema = self._loaded(name)
        self._append(schema, read_csv(self.spark, path, schema))

    def update_cells(self, name: str, cells: DataFrame, batch: int | None = None) -> None:
        """A frame as a further batch.  A numbered batch that is there already is skipped, so a repeated delivery changes nothing."""
        schema = self._loaded(name)
        if batch is not None and batch <= self.catalog.manifest(name).last_batch:
            return
        self._append(schema, self._prepared(cells, schema), batch)

    def load_partitioned(self, name: str, path: str | list[str], partitions: int, how: str = "ordered") -> None:
        """A first batch dealt out by a hash of the coordinates, or by ranges of the global order; recorded in the catalog."""
        schema = self._unloaded(name)
        if how not in ("ordered", "hash"):
            raise SchemaError("partitioning is ordered or hash")
        self._append(schema, read_csv(self.spark, path, schema), layout=(how, partitions))

    # -- data out

    def cells(self, name: str) -> DataFrame:
        """The array's live cells."""
        schema = self._loaded(name)
        manifest = self.catalog.manifest(name)
        one = len(manifest.fragments) == 1
        return fragments.live_view(self._batches(schema, manifest.fragments), schema, single=one)

    def as_view(self, name: str, view: str | None = None) -> None:
        """The live cells as a temporary view for SQL, of the array's name or another one."""
        self.cells(name).createOrReplaceTempView(view or name)

    def export_to_csv(self, name: str, path: str, *, short: bool = False, one_file: bool = False) -> None:
        write_csv(self.cells(name), path, self.schema(name), short=short, one_file=one_file)

    def get(self, name: str) -> Iterator[Row]:
        """Cells in global order, one partition at a time."""
        ordered, keys = with_order(self.cells(name), self.schema(name))
        return ordered.orderBy(*keys).select(*self.schema(name).columns).toLocalIterator()

    # -- queries

    def subarray(self, name: str, bounds: Sequence[float], result: str | None = None) -> DataFrame:
        return self._result(select.subarray(self.cells(name), self.schema(name), bounds), self.schema(name), result)

    def filter(self, name: str, expression: str, result: str | None = None) -> DataFrame:
        return self._result(select.filter_cells(self.cells(name), self.schema(name), expression), self.schema(name), result)

    def filter_predicate(self, name: str, attribute: str, op: str, operand: float, result: str | None = None) -> DataFrame:
        return self._result(select.filter_predicate(self.cells(name), self.schema(name), attribute, op, operand), self.schema(name), result)

    def filter_preset(self, name: str, attribute: str, result: str | None = None) -> DataFrame:
        return self._result(select.filter_preset(self.cells(name), self.schema(name), attribute), self.schema(name), result)

    def join(self, a: str, b: str, result: str | None = None) -> DataFrame:
        found, schema = join_arrays(self.cells(a), self.schema(a), self.cells(b), self.schema(b), result or "joined")
        return self._result(found, schema, result)

    def nearest_neighbors(self, name: str, point: Sequence[float], k: int, result: str | None = None) -> DataFrame:
        return self._result(select.nearest(self.cells(name), self.schema(name), point, k).select(*self.schema(name).columns), self.schema(name), result)

    def aggregate_max(self, name: str, attribute: str) -> DataFrame:
        return select.aggregate_max(self.cells(name), self.schema(name), attribute)

    def tiles(self, name: str) -> DataFrame:
        """The tile index: cells and bounding box of each tile."""
        schema = self.schema(name)
        return tiles.tile_index(tiles.tiled(self.cells(name), schema), schema)

    def tile(self, name: str, tile_id: int) -> DataFrame:
        """A tile's cells.  A regular tile is a range of coordinates, so only the files that may hold it are read."""
        schema = self.schema(name)
        if schema.regular:
            return self.cells(name).where(select.in_tile(schema, tile_id))
        return tiles.irregular_tiles(self.cells(name), schema).where(F.col("tile_id") == tile_id).drop("tile_id")

    def tile_by_rank(self, name: str, rank: int) -> DataFrame:
        """The cells of the tile with so many tiles before it in global order; none if there are fewer."""
        found = self.tiles(name).select("tile_id").orderBy("tile_id").offset(rank).limit(1).first()
        return self.tile(name, found["tile_id"]) if found else self.cells(name).limit(0)

    def partitioning(self, name: str) -> dict | None:
        """How a partitioned load dealt out the cells."""
        return self.catalog.manifest(self._loaded(name).name).partitioning

    def retile(self, name: str, *, capacity: int | None = None, order: str | None = None, extents: Sequence[float] | None = None) -> None:
        """Another capacity, order or tiling, in place.  extents of () make tiles irregular.  A new capacity alone moves no data."""
        old = self._loaded(name)
        if capacity is None and order is None and extents is None:
            raise SchemaError("retile needs a capacity, an order or extents")
        changes = {k: v for k, v in (("capacity", capacity), ("order", order)) if v is not None}
        if extents is not None:
            changes["extents"] = tuple(extents) or None
        new = old.clone(name, **changes)
        if new.order == old.order and new.extents == old.extents:
            self.catalog.save(name, schema=new)
            return
        manifest = self.catalog.manifest(name)
        whole = Fragment(0, manifest.next_seq, level=max(f.level for f in manifest.fragments))  # a name that no fragment has
        batches = self._batches(old, manifest.fragments)
        self._write(new, fragments.merge(batches, old, purge=True), whole)
        replaced, manifest.fragments = manifest.fragments, [whole]
        manifest.next_seq += 1
        self.catalog.save(name, manifest, new)
        self._remove(name, replaced)

    def consolidate(self, name: str, last: int | None = None) -> None:
        """Merges the last batches (all, if None) into one now."""
        manifest = self.catalog.manifest(self._loaded(name).name)
        parts = manifest.fragments[-last:] if last else manifest.fragments
        if len(parts) > 1:
            self._merge(self.schema(name), manifest, len(parts), Fragment(parts[0].lo, parts[-1].hi, max(f.level for f in parts)))

    # -- within

    def _unloaded(self, name: str) -> ArraySchema:
        schema = self.catalog.schema(name)
        if self.catalog.loaded(name):
            raise SchemaError(f"array {name} is loaded already")
        return schema

    def _loaded(self, name: str) -> ArraySchema:
        schema = self.catalog.schema(name)
        if not self.catalog.loaded(name):
            raise SchemaError(f"array {name} isn't loaded")
        return schema

    def _prepared(self, cells: DataFrame, schema: ArraySchema) -> DataFrame:
        marks = [F.col(DELETED).cast("boolean").alias(DELETED)] if DELETED in cells.columns else []
        typed = cells.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.struct()], *marks)
        return with_deletions(checked(in_reading_order(typed), schema), schema)

    def _batches(self, schema: ArraySchema, parts: list[Fragment]) -> DataFrame:
        stored = schema.struct(internal=True)
        return fragments.union([self._bucketed(schema, f) if f.buckets else self.spark.read.schema(stored).parquet(self.catalog.fragment_path(schema.name, f)) for f in parts])

    def _table(self, name: str, fragment: Fragment) -> str:
        """The session's name for a bucketed fragment."""
        return f"gridloom_{hashlib.sha256(self.catalog.fragment_path(name, fragment).encode()).hexdigest()[:16]}"

    def _bucketed(self, schema: ArraySchema, fragment: Fragment) -> DataFrame:
        """A fragment whose hash buckets Spark knows of, so that joins and views by coordinates need no exchange."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.struct(internal=True))
        dims = ", ".join(f"`{n}`" for n in schema.dim_names)
        table, path = self._table(schema.name, fragment), self.catalog.fragment_path(schema.name, fragment)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({dims}) SORTED BY ({dims}) INTO {fragment.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _write(self, schema: ArraySchema, cells: DataFrame, fragment: Fragment, partitions: int | None = None) -> None:
        """Range-partitioned and sorted in global order, so that the files' statistics prune ranges of coordinates; or hash buckets, sorted by coordinates."""
        path, dims = self.catalog.fragment_path(schema.name, fragment), schema.dim_names
        stored = [f.name for f in schema.struct(internal=True)]
        if fragment.buckets:
            spread = _last_of_each(cells.repartition(fragment.buckets, *dims), [F.col(n) for n in dims]).select(*stored)
            self._forget(schema.name, fragment)
            spread.write.bucketBy(fragment.buckets, *dims).sortBy(*dims).format("parquet").option("path", path).mode("overwrite").saveAsTable(self._table(schema.name, fragment))
            return
        ordered, keys = with_order(cells, schema)
        spread = ordered.repartitionByRange(partitions, *keys) if partitions else ordered.repartitionByRange(*keys)
        _last_of_each(spread, keys).sortWithinPartitions(*keys).select(*stored).write.mode("overwrite").parquet(path)

    def _forget(self, name: str, fragment: Fragment) -> None:
        if fragment.buckets:  # the table only: its files are elsewhere
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, fragment)}")

    def _append(self, schema: ArraySchema, cells: DataFrame, batch: int | None = None, layout: tuple[str, int] | None = None) -> None:
        manifest = self.catalog.manifest(schema.name)
        seq = manifest.next_seq
        how, partitions = layout or ("ordered", None)
        fragment = Fragment(seq, seq, buckets=partitions if how == "hash" else 0)
        self._write(schema, cells.withColumn(SEQ, F.lit(seq)), fragment, partitions)
        fragment.tombstones = True
        manifest.fragments.append(fragment)
        manifest.next_seq, manifest.last_batch = seq + 1, manifest.last_batch if batch is None else batch
        if layout:
            manifest.partitioning = {"how": layout[0], "partitions": layout[1]}
        self.catalog.save(schema.name, manifest)
        while found := due(manifest.fragments, manifest.step):
            self._merge(schema, manifest, *found)

    def _merge(self, schema: ArraySchema, manifest: Manifest, n: int, result: Fragment) -> None:
        parts = manifest.fragments[-n:]
        result.tombstones = result.lo > 0
        result.buckets = parts[0].buckets  # the first batch's layout lasts
        self._write(schema, fragments.merge(self._batches(schema, parts), schema, purge=result.lo == 0), result)
        manifest.fragments = [*manifest.fragments[:-n], result]
        self.catalog.save(schema.name, manifest)
        self._remove(schema.name, parts)

    def _remove(self, name: str, parts: list[Fragment]) -> None:
        for f in parts:
            self._forget(name, f)
            self.catalog.store.delete(name, "fragments", f.name)

    def _result(self, found: DataFrame, schema: ArraySchema, result: str | None) -> DataFrame:
        if result is None:
            return found
        new = schema.clone(result)
        if self.catalog.defined(result):
            raise SchemaError(f"array {result} is defined already")
        first = Fragment(0, 0)
        self._write(new, found.withColumn(SEQ, F.lit(0)).withColumn(DELETED, F.lit(False)), first)
        self.catalog.define(new, manifest=Manifest([first], 1))
        return self.cells(result)
