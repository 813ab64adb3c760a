"""Streams: the conflict fold as keyed state, the change log as a sink, and windowed activity with late data."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestore.operators.remember import LOG, Store

#: A store as JSON: one user's active vectors, counters and the few archived ids; it does not grow with what was archived.
STATE = "store string"


def pack(store: Store) -> str:
    active = [[i, v.tolist(), store.reinforcements[i]] for i, v in store.vectors.items()]
    return json.dumps([active, store.archived, store.next])


def unpack(text: str) -> Store:
    active, archived, number = json.loads(text)
    return Store({i: np.array(v) for i, v, _ in active}, {i: n for i, _, n in active}, [(t, i) for t, i in archived], number)


def conflict_stream(events: DataFrame, key: str = "user_id", **limits) -> DataFrame:
    """What happens to each event of a stream (key, event_id, ts in seconds, embedding), as the batch fold has it.

    Within a micro-batch a user's events are taken in order of ts and event_id;
    the state carries over, so batches cut in that order give the batch result.
    """

    def step(found, frames, state: GroupState):
        store = unpack(state.get[0]) if state.exists else Store()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            out.append((found[0], r.event_id, *store.remember(np.asarray(r.embedding, dtype=np.float64), float(r.ts), **limits), float(r.ts)))
        state.update((pack(store),))
        yield pd.DataFrame(out, columns=[key, "event_id", "event", "mem_id", "archived", "similarity", "ts"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts", "embedding").groupBy(key).applyInPandasWithState(step, LOG.format(key, kind), STATE, "append", GroupStateTimeout.NoTimeout)


def log_sink(path: str):
    """A foreachBatch function that appends batches to a log; an empty batch writes nothing, a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def activity(events: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events and their values by type and window; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )
