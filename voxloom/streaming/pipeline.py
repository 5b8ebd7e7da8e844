"""The record pipeline as Structured Streaming.

The order of a stream is a function of hashes and positions, so its cursor is the checkpoint of the query plus the
signature of its configuration: a changed configuration may not resume an old checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators.batching import fold_greedy
from voxloom.plans.config import BatchLimits, StreamConfig
from voxloom.session import ensure_checkpoint_dir
from voxloom.sources.tar import file_system, open_sink


def read_stream(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 100).parquet(folder)


def windowed_counts(events: DataFrame, at: str, width: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the newest are dropped by the watermark."""
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    window = F.window("__at", width, slide) if slide else F.window("__at", width)
    counted = stamped.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def session_counts(events: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    stamped = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counted = stamped.groupBy(F.session_window("__at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_deliveries(rows: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """One delivery of every key; the state of a key is dropped once the watermark has passed it."""
    return rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(list(keys)).drop("__at")


def split_stream(rows: DataFrame, error: Column, kept_path: str, bad_path: str, checkpoint: str, **trigger) -> None:
    """Valid rows and quarantined rows into two tables from one read of each micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("error", error).withColumn("batch", F.lit(number)).persist()
        try:
            # overwriting the folder of the micro-batch makes a retry harmless
            marked.where("error is null").drop("error", "batch").write.mode("overwrite").parquet(f"{kept_path}/batch={number}")
            marked.where("error is not null").drop("batch").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        finally:
            marked.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def live_batches(rows: DataFrame, key: str, uid: str, fields: list[str], limits: BatchLimits, idle_ms: int | None = None) -> DataFrame:
    """Greedy batches of a live stream: state per key is the open batch only, closed batches are emitted.

    With ``idle_ms`` a key that got no rows for so long emits its open batch and leaves the state; a later row of it begins
    anew with number 0.  Spark then runs empty micro-batches for ever, so a trigger that ends with the data needs
    None, under which the last batch of a key stays in the state.  Rows are ordered by uid within a micro-batch, so the batches of a stream depend on
    how it arrives; a batch number is unique within a key as long as the key stays alive.
    """
    schema = f"`{key}` string, batch bigint, uid string"
    state_schema = "number bigint, uids array<string>, costs array<array<bigint>>"

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            number, uids, _ = state.get
            state.remove()
            yield pd.DataFrame([(group[0], number, u) for u in uids], columns=[key, "batch", "uid"])
            return
        number, uids, costs = state.get if state.exists else (0, [], [])
        uids, costs = list(uids), [tuple(c) for c in costs]
        for frame in frames:
            frame = frame.sort_values(uid, kind="stable")
            uids += frame[uid].tolist()
            costs += list(frame[fields].astype("int64").itertuples(index=False, name=None))
        places = fold_greedy(costs, limits)
        last = max((p for p in places if p is not None), default=0)
        out = [(group[0], number + p, u) for p, u in zip(places, uids) if p is not None and p < last]
        rest = [(u, list(c)) for p, u, c in zip(places, uids, costs) if p == last]
        state.update((number + last, [u for u, _ in rest], [c for _, c in rest]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, "batch", "uid"])

    return rows.groupBy(key).applyInPandasWithState(fold, schema, state_schema, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Everything a stream has now, written to the shared folder and read back."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/cursor").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Cursor:
    """Checkpoint folder, local or on a shared store, bound to the signature of a configuration."""

    def __init__(self, folder: str, config: StreamConfig):
        self.folder, self.config = folder.rstrip("/"), config
        self.file = f"{self.folder}/signature.json"

    def open(self) -> str:
        """The checkpoint location; an error if it belongs to another configuration or topology."""
        mine = {"signature": self.config.signature(), "world_size": self.config.world_size, "workers": self.config.workers}
        system, place = file_system(self.file)
        if system.get_file_info(place).is_file:
            with system.open_input_stream(place) as file:
                if json.loads(file.read()) != mine:
                    raise ValueError("the checkpoint belongs to another configuration")
        else:
            with open_sink(f"{self.file}.part") as file:
                file.write(json.dumps(mine).encode())
            system.move(f"{place}.part", place)
        return f"{self.folder}/checkpoint"


def observed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with live counters: count and number of errors, visible to query listeners under ``name``."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
