"""Helpers that the operators share: words, hashes, batches and tables written between steps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text (runs of characters other than ASCII white space) as UTF-8, A-Z lower-cased.

    Bytes are lowered and split by ASCII rules, so other letters and spaces stay as they are.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hash(word: bytes) -> int:
    """64 bits, alike in any process."""
    return xxhash.xxh3_64_intdigest(word)


class WordHashes(dict):
    """64-bit hashes of words as UTF-8, remembered up to a bound; any process gives the same ones."""

    def __init__(self, bound: int = 200_000):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = word_hash(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def whole_groups(batches, names: list[str]):
    """Tables of whole groups of rows with equal ``names``, from sorted batches; a batch and a group are held at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        marks = [b.column(c).to_pylist() for c in names]
        last, cut = tuple(m[-1] for m in marks), b.num_rows
        while cut and tuple(m[cut - 1] for m in marks) == last:
            cut -= 1
        if cut:  # the group at the end may go on in the next batch
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and tuple(held[0].column(c)[0].as_py() for c in names) != last:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Gives memory that is free back to the system: workers wait for their next task beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """The function over batches, which gives its memory back when a task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def settle(spark: SparkSession) -> None:
    """Driver and executors give back what earlier steps left: a heap that has grown stays that large until a full collection."""
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").collect()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="lodestore-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def batches_by_bytes(spark: SparkSession) -> None:
    """Batches that go to Python hold ``BATCH_BYTES`` at most, whatever the length of their texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = spark.conf.get(name).lower().rstrip("b")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    batches_by_bytes(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/lodestore-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches_by_bytes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.expr(f"crc32(cast(coalesce(cast({column} as string), '') as binary)) % 5")
