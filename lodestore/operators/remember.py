"""Writes with conflict resolution: a sequential fold over each user's events."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REINFORCE, CONFLICT, KEEP_ARCHIVED = 0.95, 0.45, 3


@dataclass
class Store:
    """One user's memories by id: vectors of the active ones only, counters, the archived ones that are kept, the next id."""

    vectors: dict[int, np.ndarray] = field(default_factory=dict)
    reinforcements: dict[int, int] = field(default_factory=dict)
    archived: list[tuple[float, int]] = field(default_factory=list)  # (time, id), newest first
    next: int = 0

    def remember(self, vector: np.ndarray, ts: float, reinforce: float = REINFORCE, conflict: float = CONFLICT, keep: int = KEEP_ARCHIVED) -> tuple[str, int, list[int], float]:
        """(event, id, ids archived, similarity of the best match): reinforces the best match, or archives what conflicts and inserts.

        Of archived memories the ``keep`` newest stay, of those archived at once the highest ids.
        """
        active = list(self.vectors)
        sims = np.maximum(0.0, np.array(list(self.vectors.values())) @ vector) if active else np.empty(0)
        best = int(sims.argmax()) if active else -1
        most = float(sims[best]) if active else 0.0
        if active and most >= reinforce:
            self.reinforcements[active[best]] += 1
            return "reinforced", active[best], [], most
        gone = [i for i, s in zip(active, sims.tolist(), strict=True) if s >= conflict]
        for i in gone:
            del self.vectors[i], self.reinforcements[i]
        self.archived = sorted([*self.archived, *((ts, i) for i in gone)], reverse=True)[:keep]
        self.vectors[self.next], self.reinforcements[self.next] = vector, 1
        self.next += 1
        return ("conflict" if gone else "stored"), self.next - 1, gone, most


LOG = "{} {}, event_id long, event string, mem_id long, archived array<long>, similarity double, ts double"


def conflict_fold(events: DataFrame, key: str = "user_id", **limits) -> DataFrame:
    """What happened to each event (key, event_id, ts in seconds, embedding), in order of ts and event_id.

    The rule compares an event with the state that all earlier ones left, so a
    user's events are one group; users are spread over all tasks.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        store, out = Store(), []
        for r in rows.sort_values(["ts", "event_id"], kind="stable").itertuples():
            out.append((getattr(r, key), r.event_id, *store.remember(np.asarray(r.embedding, dtype=np.float64), float(r.ts), **limits), float(r.ts)))
        return pd.DataFrame(out, columns=[key, "event_id", "event", "mem_id", "archived", "similarity", "ts"])

    return events.select(key, "event_id", "ts", "embedding").groupBy(key).applyInPandas(fold, LOG.format(key, events.schema[key].dataType.simpleString()))


def archived_memories(log: DataFrame, key: str = "user_id", keep: int = KEEP_ARCHIVED) -> DataFrame:
    """key, mem_id, archived_by (event_id): the archived memories that each user still has, from the fold's log."""
    gone = log.select(key, "event_id", F.explode("archived").alias("mem_id"))
    w = Window.partitionBy(key).orderBy(F.desc("event_id"), F.desc("mem_id"))
    return gone.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select(key, "mem_id", F.col("event_id").alias("archived_by"))


def conflict_log(log: DataFrame, user=None, key: str = "user_id") -> DataFrame:
    """What the fold decided other than plain inserts, of one user if given: event, ids and the similarity, rounded."""
    found = log.where(F.col("event") != "stored")
    found = found if user is None else found.where(F.col(key) == user)
    return found.select(key, "event_id", "event", "mem_id", "archived", F.round("similarity", 4).alias("similarity"))


def memory_state(log: DataFrame, key: str = "user_id", keep: int = KEEP_ARCHIVED) -> DataFrame:
    """key, mem_id, event_id, ts, reinforcements, last_reinforced, status: the memories that the fold's log leaves.

    Status is active, archived (the ``keep`` newest of a user) or deleted.
    """
    made = log.where(F.col("event") != "reinforced").select(key, "mem_id", "event_id", "ts")
    again = log.where(F.col("event") == "reinforced").groupBy(key, "mem_id").agg(F.count(F.lit(1)).alias("times"), F.max("ts").alias("last_reinforced"))
    gone = log.select(key, F.explode("archived").alias("mem_id")).withColumn("gone", F.lit(True))
    kept = archived_memories(log, key, keep).select(key, "mem_id", F.lit(True).alias("kept"))
    joined = made.join(again, [key, "mem_id"], "left").join(gone, [key, "mem_id"], "left").join(kept, [key, "mem_id"], "left")
    status = F.when(F.col("gone").isNull(), "active").when(F.col("kept"), "archived").otherwise("deleted")
    return joined.select(key, "mem_id", "event_id", "ts", (1 + F.coalesce("times", F.lit(0))).alias("reinforcements"), "last_reinforced", status.alias("status"))
