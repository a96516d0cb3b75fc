"""The folds over tables and streams of events: key, event_id, ts (seconds), event_type and value.

In batch a key's events are one group, sorted by time and id; the group streams through the fold in Arrow batches, so
a hot key needs no memory, and only its own order is sequential by nature. As a stream the state of a key is kept as
JSON in Spark's state store, with a time to live where the fold forgets; there a key's events of one micro-batch are
sorted in memory, so that the source's batches (maxFilesPerTrigger, maxOffsetsPerTrigger) bound it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from gradeveil.functions import shared
from gradeveil.streaming import folds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events whose decisions a stream gives out at a time.
PART_ROWS = 10_000
DECISIONS = "key string, event_id long, ts double, decision string, amount double"


def events_of(df: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events in the shape that the folds take; times in seconds."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.select(F.col(key).cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), seconds.alias("ts"), F.col("event_type").cast("string").alias("event_type"), F.col("value").cast("double").alias("value"))


def decisions(events: DataFrame, fold: str, **parameters) -> DataFrame:
    """Each event's decision and amount; ties in time go by id. An event without time has no place in the order: its
    decision is no_time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("event_id", pa.int64()), ("ts", pa.float64()), ("decision", pa.string()), ("amount", pa.float64())])
        key, state = object(), None
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for k, now, kind, value in zip(rows["key"], rows["ts"], rows["event_type"], rows["value"], strict=True):
                if k != key:
                    key, state = k, folds.new(fold, parameters)
                out.append(state.step(now, kind, value))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), batch.column("ts"), pa.array([o["decision"] for o in out], pa.string()), pa.array([o["amount"] for o in out], pa.float64())], schema=schema)

    ordered = events.where("ts is not null").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    untimed = events.where("ts is null").select("key", "event_id", "ts", F.lit("no_time").alias("decision"), F.lit(None).cast("double").alias("amount"))
    return ordered.mapInArrow(run, DECISIONS).unionByName(untimed)


class FoldProcessor(StatefulProcessor):
    """A fold as a streaming operator; ttl_ms: how long an idle key's state is kept (0: for ever)."""

    def __init__(self, fold: str, parameters: dict, ttl_ms: int = 0):
        self.fold, self.parameters, self.ttl_ms = fold, parameters, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", StructType([StructField("json", StringType())]), self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold = folds.new(self.fold, json.loads(self.state.get()[0]) if self.state.exists() else self.parameters)
        # the fold needs time order over the whole micro-batch: only its four columns are held, answers leave in parts
        held = []
        for part in rows:
            untimed = part[part.ts.isna()]
            if len(untimed):
                yield pd.DataFrame({"key": key[0], "event_id": untimed.event_id, "ts": untimed.ts, "decision": "no_time", "amount": None})
            held.append(part[["event_id", "ts", "event_type", "value"]].dropna(subset=["ts"]))
        events = pd.concat(held).sort_values(["ts", "event_id"])
        held.clear()
        for k in range(0, len(events), PART_ROWS):
            part = events.iloc[k : k + PART_ROWS]
            out = [fold.step(now, kind, value) for now, kind, value in zip(part.ts, part.event_type, part.value, strict=True)]
            yield pd.DataFrame({"key": key[0], "event_id": part.event_id, "ts": part.ts, "decision": [o["decision"] for o in out], "amount": [o["amount"] for o in out]})
        self.state.update((json.dumps(folds.frozen(fold)),))

    def close(self) -> None:
        pass


def decision_stream(events: DataFrame, fold: str, ttl_ms: int = 0, **parameters) -> DataFrame:
    """decisions() over a stream. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return events.groupBy("key").transformWithStateInPandas(FoldProcessor(fold, parameters, ttl_ms), DECISIONS, "Append", "None")


def replayed(stream: DataFrame) -> DataFrame:
    """Runs a stream over what its source has now and returns what it wrote. Output and state go to a new folder in
    spark.checkpoint.dir."""
    spark = stream.sparkSession
    folder = shared.working_folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def sessions(events: DataFrame, gap_seconds: float = 0.35) -> DataFrame:
    """key, session, start, end and events: bursts of a key's events with no gap of gap_seconds or more."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(order) >= gap_seconds).cast("int"), F.lit(0))
    marked = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(order))
    return marked.groupBy("key", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"))


def revisions(events: DataFrame, changes: Column) -> DataFrame:
    """Each event with the number of changes so far and whether there was any (a latch)."""
    order = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("revision", F.sum(changes.cast("long")).over(order)).withColumn("latched", F.max(changes).over(order))


def stable_pairs(revised: DataFrame) -> DataFrame:
    """Events whose revision equals that of the event before: two polls that agree."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    return revised.withColumn("__before", F.lag("revision").over(order)).where("revision = __before").drop("__before")


def expired(jobs: DataFrame, now: float, ttl: float = 300.0, updated_at: str = "ts") -> DataFrame:
    """Jobs past their time to live."""
    return jobs.where(F.col(updated_at) <= F.lit(now - ttl))


def restarted(jobs: DataFrame) -> DataFrame:
    """Jobs as they are after a restart: those that were pending have failed."""
    return jobs.withColumn("failure", F.when(F.col("state") == "pending", "server_restarted").otherwise(F.col("failure"))).withColumn("state", F.when(F.col("state") == "pending", "failed").otherwise(F.col("state")))


def event_counters(stream: DataFrame) -> DataFrame:
    """Monotone counters by name, in batch or as a stream."""
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
