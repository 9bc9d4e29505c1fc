"""Structured Streaming forms of the queues, windows and limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream of bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(stream: DataFrame, ts: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and keys; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("slot"), *keys, "n")


def first_per_key(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def guard_future(df: DataFrame, ts: str, as_of, hours: int = 1) -> DataFrame:
    """Times beyond as_of by more than the slack become null."""
    return df.withColumn(ts, F.when(F.col(ts) > as_of + F.expr(f"make_dt_interval(0, {hours})"), None).otherwise(F.col(ts)))


def leak(used: float, elapsed: float, limit: float, window: float, cost: float) -> tuple[bool, float, int]:
    """(allowed, used afterwards, seconds to wait) of a leaky bucket."""
    rate = limit / window
    used = max(0.0, used - elapsed * rate)
    if used + cost <= limit:
        return True, used + cost, 0
    return False, used, int((used + cost - limit) / rate) + 1


def rate_limited(requests: DataFrame, limit: float, window: float) -> DataFrame:
    """(key, ts, cost, allowed, wait) with the bucket's level and time as state per key; times are epoch seconds."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, last = state.get if state.exists else (0.0, None)
        for pdf in frames:
            out = []
            for ts, cost in pdf.sort_values("ts")[["ts", "cost"]].itertuples(index=False):
                ok, used, wait = leak(used, max(0.0, ts - last) if last is not None else 0.0, limit, window, cost)
                last = max(ts, last) if last is not None else ts
                out.append((key[0], ts, cost, ok, wait))
            yield pd.DataFrame(out, columns=["key", "ts", "cost", "allowed", "wait"])
        if last is not None:
            state.update((used, last))

    return requests.groupBy("key").applyInPandasWithState(step, "key string, ts double, cost double, allowed boolean, wait long", "used double, last double", "append", GroupStateTimeout.NoTimeout)


def rate_limited_batch(requests: DataFrame, limit: float, window: float) -> DataFrame:
    """X9 over a finite table: (key, allowed, rejected, used) by an ordered fold per key; ``used`` with 6 decimals.

    Requests are sorted by key, ts and cost within partitions and folded as they stream by: a task holds one bucket,
    however many requests a key has. Null keys are one key; requests without a time come first and drain nothing.
    """
    kind = requests.schema["key"].dataType.simpleString()
    names = ["key", "allowed", "rejected", "used"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            done: list[tuple] = []
            for key, ts, cost in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        done.append((state[0], state[3], state[4], round(state[1], 6)))
                    state = [key, 0.0, None, 0, 0]
                ok, state[1], _ = leak(state[1], ts - state[2] if ts is not None and state[2] is not None else 0.0, limit, window, cost)
                state[2] = ts
                state[3 if ok else 4] += 1
            yield _limited(done, batch.schema.field(0).type, names)
        if state is not None:
            yield _limited([(state[0], state[3], state[4], round(state[1], 6))], batch.schema.field(0).type, names)

    dealt = requests.select("key", F.col("ts").cast("double").alias("ts"), F.col("cost").cast("double").alias("cost")).repartition("key")
    return dealt.sortWithinPartitions("key", "ts", "cost").mapInArrow(fold, f"key {kind}, allowed long, rejected long, used double")


def _limited(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)


def run_stages(batch: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], cut: int = 500) -> DataFrame:
    """One micro-batch of jobs (id, queue_name, status, msg, ...) through the stages of its queues, in order.

    A stage is the name of a queue and a function from its jobs to (id, outcome, next_queue, error). A job with an
    error fails with its message cut to ``cut`` characters; one with a next queue goes on there, in this batch if that
    stage is still to come; all others are done. Jobs of other queues pass by. Use it in ``foreachBatch``.
    """
    jobs = batch
    for name, stage in stages:
        own = F.col("queue_name") == name
        results = stage(jobs.filter(own & (F.col("status") == "PENDING"))).select("id", F.col("outcome").alias("_outcome"), F.col("next_queue").alias("_next"), F.col("error").alias("_error"), F.lit(True).alias("_ran"))
        j = jobs.join(results, "id", "left")
        ran, failed = F.coalesce("_ran", F.lit(False)), F.col("_error").isNotNull()
        status = F.when(failed, "FAILED").when(F.col("_next").isNotNull(), "PENDING").otherwise("COMPLETED")
        jobs = j.withColumns({
            "status": F.when(ran, status).otherwise(F.col("status")),
            "msg": F.when(ran, F.when(failed, F.substring("_error", 1, cut)).otherwise(F.col("_outcome"))).otherwise(F.col("msg")),
            "queue_name": F.when(ran & ~failed, F.coalesce("_next", "queue_name")).otherwise(F.col("queue_name")),
        }).select(*batch.columns)
    return jobs
