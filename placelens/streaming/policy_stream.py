"""Arm values kept up to date from a stream of feedback events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placelens.functions.frames import range_count
from placelens.functions.lexicons import ALPHA
from placelens.operators.policy import chain_segments, clean_intent, complete_state, known_arms, segment_values

_STATE = "intent string, arm string, q_value double, pull_count bigint"
_CLOCK = "max_ts timestamp, late_events bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


class QStateStream:
    """Folds micro-batches of reward events into a versioned state table.

    A batch is a bounded table: its events are ordered by (ts, event_id), folded range by range, and the nine
    resulting rows are chained to the state of the previous batch. The state of batch n is written under its
    own folder, so a batch that runs again after a failure starts from the same state and overwrites only its
    own result. Batches follow each other in arrival order. Events more than ``late_seconds`` older than the
    newest event of earlier batches are left out and counted.
    """

    def __init__(self, folder: str, alpha: float = ALPHA, late_seconds: int | None = None):
        self.folder, self.alpha, self.late_seconds = folder, alpha, late_seconds

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def fold_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = known_arms(batch).select(
            clean_intent(F.col("intent")).alias("intent"), "arm", "reward", F.col("ts").cast("timestamp").alias("ts"), "event_id"
        )
        first = batch_id == 0
        before = None if first else _read(spark, self._path("state", batch_id - 1), _STATE)
        clock = None if first else _read(spark, self._path("clock", batch_id - 1), _CLOCK)
        late = F.lit(False)
        if clock is not None and self.late_seconds is not None:
            newest = clock.select("max_ts").scalar()
            late = F.coalesce(F.unix_micros("ts") < F.unix_micros(newest) - self.late_seconds * 1_000_000, F.lit(False))
        kept = rows.where(~late)
        ranged = kept.repartitionByRange(range_count(kept), "ts", "event_id").withColumn("segment", F.spark_partition_id())
        state = chain_segments(segment_values(ranged, ["ts", "event_id"], self.alpha), self.alpha, before)
        state.coalesce(1).write.mode("overwrite").parquet(self._path("state", batch_id))
        seen = rows.agg(F.max("ts").alias("max_ts"), F.count_if(late).alias("late_events"))
        if clock is not None:
            seen = seen.unionByName(clock).agg(F.max("max_ts").alias("max_ts"), F.sum("late_events").alias("late_events"))
        seen.coalesce(1).write.mode("overwrite").parquet(self._path("clock", batch_id))

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.fold_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return complete_state(_read(spark, self._path("state", batch_id), _STATE))

    def late_events(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return _read(spark, self._path("clock", batch_id), _CLOCK)


def feedback_log_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append raw feedback rows to a Parquet log."""
    return (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
