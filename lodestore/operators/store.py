"""The store's life cycle on tables: inserts with dense ids, updates, deletions, purges, listings, sizes and triggers.

A store is a table (user_id, vec_id, embedding, ...).  Vectors are made unit length
when they are written, so that products of stored vectors are cosines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import vector

KEYS = ["user_id", "vec_id"]
#: The store's defaults: writes between checkpoints and consolidations, vectors from which codes are made, deletions of a user from which it is compacted.
CHECKPOINT_EVERY, CONSOLIDATE_EVERY, QUANTISE_FROM, COMPACT_FROM = 100, 500, 100, 1000


def normalized(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors; zero vectors stay."""
    return rows.withColumn(column, vector.normalize(F.col(column)))


def with_defaults(rows: DataFrame, now: float) -> DataFrame:
    """``rows`` as they are written: active, with a time (``now`` where there is none), one reinforcement, full weight, no conflict, unit vectors."""
    starting = {"status": F.lit("active"), "ts": F.lit(now), "reinforcements": F.lit(1), "bio_weight": F.lit(1.0), "conflict_score": F.lit(0.0)}
    for name, value in starting.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return normalized(rows) if "embedding" in rows.columns else rows


def numbered(rows: DataFrame, key: str, time: str, tie: str, name: str = "number", buckets: int = 64) -> DataFrame:
    """``rows`` with their number from 0 within each key, in order of ``time`` (a number) and ``tie``.

    A key's rows are numbered within slices of the whole table's time range and the
    sizes of the slices before are added, so a key with many rows is many groups.
    """
    ends = rows.agg(F.min(time).alias("numbered: lo"), F.max(time).alias("numbered: hi"))
    share = (F.col(time) - F.col("numbered: lo")) / (F.col("numbered: hi") - F.col("numbered: lo"))
    slice_of = F.when(F.col("numbered: hi") > F.col("numbered: lo"), F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    sliced = rows.crossJoin(F.broadcast(ends)).withColumn("numbered: slice", F.coalesce(slice_of, F.lit(-1))).drop("numbered: lo", "numbered: hi")
    sizes = sliced.groupBy(key, "numbered: slice").agg(F.count(F.lit(1)).alias("numbered: n"))
    before = Window.partitionBy(key).orderBy("numbered: slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "numbered: slice", F.coalesce(F.sum("numbered: n").over(before), F.lit(0)).alias("numbered: before"))
    place = F.row_number().over(Window.partitionBy(key, "numbered: slice").orderBy(time, tie))
    placed = sliced.withColumn("numbered: place", place).join(offsets, [key, "numbered: slice"])
    return placed.select(*rows.columns, (F.col("numbered: before") + F.col("numbered: place") - 1).cast("long").alias(name))


def counters(store: DataFrame) -> DataFrame:
    """user_id, next: the id that a user's next insert gets; explicit ids raise it."""
    return store.groupBy("user_id").agg((F.max("vec_id") + 1).alias("next"))


def insert(store: DataFrame, rows: DataFrame, time: str, tie: str) -> DataFrame:
    """``rows`` (user_id, ...) with the dense ids that they get as inserts into ``store``, in order of time."""
    new = numbered(rows, "user_id", time, tie, "vec_id")
    return new.join(counters(store), "user_id", "left").withColumn("vec_id", F.col("vec_id") + F.coalesce("next", F.lit(0))).drop("next")


def existing(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that the store holds."""
    return keys.select(*KEYS).distinct().join(store.select(*KEYS), KEYS, "left_semi")


def update(store: DataFrame, changes: DataFrame, kept: tuple[str, ...] = ("ts", "reinforcements"), reset: dict | None = None) -> DataFrame:
    """The store after updates of rows that it holds; others change nothing.

    Columns in ``kept`` and null values of ``changes`` keep what was stored; ``reset``
    gives columns their starting values (by default a weight of 1, no conflict).
    """
    reset = {"bio_weight": 1.0, "conflict_score": 0.0} if reset is None else reset
    new = changes.select(*KEYS, F.struct(*[c for c in changes.columns if c not in KEYS]).alias("update: new"))
    joined = store.join(new, KEYS, "left")
    changed = F.col("update: new").isNotNull()

    def value(c: str) -> Column:
        if c in reset:
            return F.when(changed, F.lit(reset[c])).otherwise(F.col(c)).alias(c)
        if c in KEYS or c in kept or c not in changes.columns:
            return F.col(c)
        return F.coalesce(F.col("update: new")[c], F.col(c)).alias(c)

    return joined.select(*[value(c) for c in store.columns])


def forget(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without these rows."""
    return store.join(keys.select(*KEYS).distinct(), KEYS, "left_anti")


def purge(store: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the store without the users' rows, archived ones included; user_id, deleted)."""
    users = users.select("user_id").distinct()
    return store.join(users, "user_id", "left_anti"), store.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("deleted"))


def to_compact(tombstones: DataFrame, least: int = COMPACT_FROM) -> DataFrame:
    """user_id, pending: the users whose pending deletions call for a compaction."""
    return tombstones.groupBy("user_id").agg(F.count(F.lit(1)).alias("pending")).where(F.col("pending") >= least)


def latest(rows: DataFrame, key: str, k: int, time: str, tie: str) -> DataFrame:
    """``rows`` with ``kept``: whether a row is among its key's k latest; only k rows a key and task are sorted."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    few = rows.select(key, tie, time).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(key, tie, F.lit(True).alias("kept"))
    return rows.join(few, [key, tie], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def reinforce(rows: DataFrame, hits: DataFrame, now: float | None = None) -> DataFrame:
    """Counters one higher for each hit (user_id, vec_id); with ``now`` the time is refreshed, too."""
    times = hits.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("times"))
    joined = rows.join(times, KEYS, "left")
    out = joined.withColumn("reinforcements", F.col("reinforcements") + F.coalesce("times", F.lit(0)))
    if now is not None:
        out = out.withColumn("ts", F.when(F.col("times").isNotNull(), F.lit(now)).otherwise(F.col("ts")))
    return out.drop("times")


def with_conflict(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Conflict scores (user_id, vec_id, score) put into 0..1 on the rows that have one."""
    clamped = scores.select(*KEYS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("conflict: new"))
    return rows.join(clamped, KEYS, "left").withColumn("conflict_score", F.coalesce("conflict: new", "conflict_score")).drop("conflict: new")


def archived(rows: DataFrame, user: Column | None = None) -> DataFrame:
    """The archived rows, of one user if given."""
    found = rows.where(F.col("status") == "archived")
    return found if user is None else found.where(F.col("user_id") == user)


def api_results(ranked: DataFrame) -> DataFrame:
    """The shape in which results go out: the text, or the action where there is none."""
    return ranked.select("user_id", "event_id", F.coalesce("text", "action").alias("text"), "action", F.round("score", 6).alias("score"), "reinforcements", F.round("age_h", 2).alias("hours_ago"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path; 0 where there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def stats(store: DataFrame, dim: int, log_path: str | None = None, path: str | None = None, coded: bool = False, cycles: int = 0) -> DataFrame:
    """One row: users, vectors, dimension, bytes of the log and of the snapshots, codes, consolidations so far."""
    spark = store.sparkSession
    size = lambda p: folder_bytes(spark, p) if p else 0
    return store.agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("total_vectors")).select(
        "users", "total_vectors", F.lit(dim).alias("dim"), F.lit(size(log_path)).alias("wal_size_bytes"), F.lit(size(path)).alias("storage_size_bytes"),
        F.lit("SQ8" if coded else "none").alias("quantization"), F.lit("4x" if coded else "1x").alias("ram_reduction"), F.lit(cycles).alias("consolidation_cycle"),
    )


@dataclass
class Triggers:
    """What is due after so many writes: for the function of a stream's batches that maintains a store."""

    checkpoint_every: int = CHECKPOINT_EVERY
    consolidate_every: int = CONSOLIDATE_EVERY
    quantise_from: int = QUANTISE_FROM
    quantise: bool = False
    writes: int = 0
    coded: bool = False

    def after(self, writes: int, total: int) -> list[str]:
        """The tasks that ``writes`` more writes make due, in their order; total: vectors in the store."""
        before, self.writes = self.writes, self.writes + writes
        due = []
        if self.quantise and not self.coded and total >= self.quantise_from:
            self.coded = True
            due.append("quantise")
        if self.consolidate_every and self.writes // self.consolidate_every > before // self.consolidate_every:
            due.append("consolidate")
        if self.checkpoint_every and self.writes // self.checkpoint_every > before // self.checkpoint_every:
            due.append("checkpoint")
        return due
