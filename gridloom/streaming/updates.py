"""Update batches from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def stream_updates(engine: Engine, name: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch becomes one update of a loaded array.  Batches carry their number into the catalog, so one that is delivered again after a failure is skipped."""
    return stream.writeStream.foreachBatch(lambda cells, number: engine.update_cells(name, cells, batch=number)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
