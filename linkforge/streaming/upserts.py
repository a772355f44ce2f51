"""Arrivals as a stream: each micro-batch is reduced per key and merged into the Parquet state.

The state's writer swaps directories, so a batch that fails midway leaves the old version; a batch that is
repeated after a failure gives the same state, as the merge is by key and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from linkforge.operators.keyed import upsert
from linkforge.operators.ordering import last_wins
from linkforge.sources.readers import state_table
from linkforge.sources.sinks import replace_state


def merge_arrivals(spark: SparkSession, batch: DataFrame, state: str, schema: str, keys: list[str], order: str, keep: dict[str, str] | None = None) -> None:
    """Merge one batch: its last row per key by ``order``, over the stored version."""
    old = state_table(spark, state, schema)
    new = last_wins(batch.select(*old.columns), [F.col(k) for k in keys], F.col(order))
    replace_state(upsert(old, new, keys, keep), state)


def stream_upserts(spark: SparkSession, arrivals: str, state: str, schema: str, keys: list[str], order: str, checkpoint: str, keep: dict[str, str] | None = None) -> StreamingQuery:
    """Read JSON arrivals as they come and keep the state up to date; runs until all present files are merged."""
    source = spark.readStream.schema(schema).json(arrivals)
    merge = lambda batch, _: merge_arrivals(spark, batch, state, schema, keys, order, keep)
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts per time window with a bound on lateness."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
