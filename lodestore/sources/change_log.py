"""The change log: records, replay after the last checkpoint, compaction, truncation, snapshots, and other files.

A log is a table (seq, op, user_id, vec_id, value ...); op is INSERT, UPDATE,
DELETE or CHECKPOINT.  Snapshots are numbered folders; one counts when the marker
that is written last is there, and the highest number is the current one, so a
crash leaves the one before and a reader never sees half a snapshot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import vector as vectors

OPS = ("INSERT", "UPDATE", "DELETE", "CHECKPOINT")
KEYS = ["user_id", "vec_id"]


def last_checkpoint(log: DataFrame) -> int:
    """The greatest seq of a checkpoint, -1 without one."""
    found = log.where(F.col("op") == "CHECKPOINT").agg(F.max("seq").alias("seq")).first().seq
    return -1 if found is None else found


def read_log(spark: SparkSession, path: str, schema: str = "seq long, op string, user_id string, vec_id long, embedding array<double>, meta string") -> DataFrame:
    """A log of JSON lines, up to the first line that can't be read or is cut off."""
    corrupt = "_corrupt_record"
    parsed = F.from_json("value", f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    # a line that can't be read has no seq: it stands after the lines before it
    rows = spark.read.text(path).select(parsed.alias("r")).select("r.*", F.monotonically_increasing_id().alias("log: place"))
    return intact(rows, corrupt, "log: place").drop("log: place")


def intact(log: DataFrame, corrupt: str = "_corrupt_record", order: str = "seq") -> DataFrame:
    """Records before the first that could not be read."""
    first = log.agg(F.min(F.when(F.col(corrupt).isNotNull(), F.col(order))).alias("log: bad"))
    return log.crossJoin(F.broadcast(first)).where(F.col("log: bad").isNull() | (F.col(order) < F.col("log: bad"))).drop("log: bad", corrupt)


def records(rows: DataFrame, op: str, first: int = 0) -> DataFrame:
    """Log records of rows (user_id, vec_id, ...) in order of ``seq``, or of one operation on each."""
    if op not in OPS:
        raise ValueError(f"unknown operation: {op}")
    return rows.withColumn("op", F.lit(op)).withColumn("seq", F.col("seq") + F.lit(first))


def checkpoint_record(log: DataFrame) -> DataFrame:
    """The record that closes a log: the system's user, no vector, the next seq."""
    last = log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))
    values = {"seq": F.col("seq"), "op": F.lit("CHECKPOINT"), "vec_id": F.lit(-1)}
    user = F.lit("__system__") if log.schema["user_id"].dataType.simpleString() == "string" else F.lit(None)
    return last.select(*[values.get(f.name, user if f.name == "user_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema.fields])


def replay(log: DataFrame, snapshot: DataFrame | None = None, vector: str | None = None) -> DataFrame:
    """The live rows, as if the records were applied one by one over the snapshot.

    An INSERT makes or replaces a row, an UPDATE changes a row that is there and
    nothing else, a DELETE removes it.  So a key lives if an INSERT follows its last
    DELETE, and its last record is the row.  INSERT and UPDATE records whose
    ``vector`` is null are skipped.  All is found in one aggregation that combines
    before the shuffle.
    """
    changes = log.where(F.col("op") != "CHECKPOINT")
    if vector is not None:
        changes = changes.where((F.col("op") == "DELETE") | F.col(vector).isNotNull())
    if snapshot is not None:
        changes = changes.where(F.col("seq") > last_checkpoint(log))
        changes = snapshot.withColumn("seq", F.lit(-1).cast("long")).withColumn("op", F.lit("INSERT")).unionByName(changes, allowMissingColumns=True)
    rest = [c for c in changes.columns if c not in KEYS]
    seq_of = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    last = changes.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "seq").alias("last"), seq_of("INSERT").alias("made"), seq_of("DELETE").alias("gone"))
    live = last.where(F.col("made").isNotNull() & (F.col("gone").isNull() | (F.col("made") > F.col("gone"))))
    return live.select(*KEYS, *[F.col(f"last.{c}").alias(c) for c in rest])


def truncate(log: DataFrame) -> DataFrame:
    """What is left of a log after its last checkpoint."""
    return log.where(F.col("seq") > last_checkpoint(log))


def compact(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows (with their ``seq``) without those that a tombstone of a later ``seq`` deletes."""
    gone = tombstones.groupBy(*KEYS).agg(F.max("seq").alias("log: gone"))
    return rows.join(gone, KEYS, "left").where(F.col("log: gone").isNull() | (F.col("seq") > F.col("log: gone"))).drop("log: gone")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Versions of the snapshot format that can be read.
FORMAT = 1


def _versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of complete snapshots, lowest first: a folder counts once its marker is there."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    names = [n.removeprefix("snapshot-") for n in found if n.startswith("snapshot-")]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_fs(spark, f"{root}/snapshot-{n}/COMPLETE")[1]))


def save_snapshot(rows: DataFrame, root: str, extras: dict[str, DataFrame] | None = None) -> int:
    """Writes the next snapshot; its marker, written last, makes it the current one.  Older ones stay readable.

    extras: small tables saved beside the rows, such as a quantiser.
    """
    spark = rows.sparkSession
    number = max(_versions(spark, root), default=0) + 1
    folder = f"{root}/snapshot-{number}"
    fs, path = _fs(spark, folder)
    fs.delete(path, True)  # what a writer that did not end has left
    rows.write.parquet(f"{folder}/rows")
    for name, table in (extras or {}).items():
        table.write.parquet(f"{folder}/{name}")
    out = fs.create(_fs(spark, f"{folder}/COMPLETE")[1], True)
    out.write(str(FORMAT).encode())
    out.close()
    return number


def has_snapshot(spark: SparkSession, root: str) -> bool:
    return bool(_versions(spark, root))


def load_snapshot(spark: SparkSession, root: str, table: str = "rows") -> DataFrame | None:
    """The current snapshot's rows, or the extra of that name; None without one."""
    found = _versions(spark, root)
    if not found:
        return None
    folder = f"{root}/snapshot-{found[-1]}"
    if int(spark.read.text(f"{folder}/COMPLETE").first().value) > FORMAT:
        raise RuntimeError(f"{folder}: a newer format")
    fs, path = _fs(spark, f"{folder}/{table}")
    return spark.read.parquet(f"{folder}/{table}") if fs.exists(path) else None


def drop_old_snapshots(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the newest snapshots; how many were deleted."""
    old = _versions(spark, root)[:-keep]
    for number in old:
        fs, path = _fs(spark, f"{root}/snapshot-{number}")
        fs.delete(path, True)
    return len(old)


def checkpoint(log: DataFrame, root: str) -> DataFrame:
    """Saves what the log makes of the current snapshot, and returns the log that is left: its closing record alone.

    A log without changes since its last checkpoint is returned as it is.
    """
    spark = log.sparkSession
    if truncate(log).isEmpty():
        return log
    closed = checkpoint_record(log)
    save_snapshot(replay(log, load_snapshot(spark, root)).drop("seq", "op"), root)
    return closed


def quarantine(spark: SparkSession, root: str, mark: str) -> bool:
    """Moves unreadable state aside; True if there was any."""
    fs, path = _fs(spark, root)
    return bool(fs.exists(path) and fs.rename(path, _fs(spark, f"{root}.corrupt-{mark}")[1]))


def recover(spark: SparkSession, root: str, log: DataFrame, log_path: str | None = None) -> DataFrame:
    """The live rows after a crash: the snapshot and the log after its last checkpoint.

    A snapshot that can't be read is put aside, with the log's files, which belong to
    it, and the store starts empty.
    """
    try:
        found = load_snapshot(spark, root)
    except Exception:  # any reader's error: the state must not keep the store from starting
        mark = uuid.uuid4().hex[:8]
        quarantine(spark, root, mark)
        if log_path is not None:
            quarantine(spark, log_path, mark)
        return replay(spark.createDataFrame([], log.schema))
    return replay(log, found)


def read_glove(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """word, v (unit length) from a text of words and numbers; lines with anything else and zero vectors are skipped."""
    parts = F.split("value", " ")
    numbers = F.transform(F.slice(parts, 2, 1_000_000), lambda x: x.try_cast("double"))
    rows = spark.read.text(path).select(parts[0].alias("word"), numbers.alias("v"))
    good = rows.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0))
    good = good.withColumn("v", vectors.normalize(F.col("v")))
    return good if most is None else good.limit(most)


def gaussian_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """vec_id, embedding: unit vectors of independent normal numbers."""
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed + k) for k in range(dim)]).alias("embedding"))
    return rows.withColumn("embedding", vectors.normalize(F.col("embedding")))


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark results; an old header names the engine ``config``."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumnRenamed("config", "engine") if "config" in rows.columns and "engine" not in rows.columns else rows


def write_benchmark_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
