"""Products with the TF-IDF matrix of a corpus, which lies in blocks; no entry ever carries a vector.

A block holds whole texts as numbers of its own tokens, packed.  A token of one
block only is that block's affair: its vector follows from the block's texts.  A
token of several blocks has its place in a part of the vocabulary; between the two
go, in an order settled once, the vectors of the tokens that a block has, one for
all of its texts.  What a step moves is therefore a vector for each block that a
token occurs in, at most, ``SLICE`` numbers of it at a time, and it is gone before the
next step begins.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import string
import sys
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lodestore.functions import text as T

#: Bounds of a block (tokens, entries) and of a chunk of it (entries, texts); bytes of text for a task; bytes of a part's vectors; tokens that are broadcast.
BLOCK_TOKENS, BLOCK_ENTRIES, CHUNK, TEXTS = 1 << 20, 1 << 24, 1 << 20, 1 << 14
TASK_BYTES, PART_BYTES, BROADCAST_TOKENS, BATCH_BYTES = 1 << 27, 1 << 22, 1 << 18, 8 << 20
#: Entries of a product, and numbers of a vector that a step takes.
STRIP, SLICE = 1 << 14, 16
#: Kinds of rows, in the order in which a step reads them.
NAMES, LOCAL, ROUTE, OLD, TEXT = range(5)
SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
BLOBS = ("a", "b", "c", "d", "v", "g")


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder; a temporary one only where none is set and all run on one machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestore-checkpoint-"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = spark.conf.get(name).lower().rstrip("b")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    path = f"{sc.getCheckpointDir().rstrip('/')}/weights-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the step's shuffle files go with it
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before) if before is not None else spark.conf.unset(clean)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        if df is not None:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(df: DataFrame) -> None:
    """Spark deletes the shuffle files of steps that are over once the driver has collected its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def released(run):
    """The function over batches, which gives its memory back when a task ends: workers wait for their next one beside others."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # another C library
                    ctypes.CDLL(None).malloc_trim(0)

    return task


def schema(id_type: str) -> str:
    return f"block long, q long, kind int, part long, ids array<{id_type}>, tokens array<string>, " + ", ".join(f"{x} binary" for x in BLOBS)


class Rows:
    """Makes batches of one row in the common layout."""

    def __init__(self, id_type: pa.DataType):
        self.types = pa.schema([("block", pa.int64()), ("q", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("ids", pa.list_(id_type)), ("tokens", pa.list_(pa.string())), *((x, pa.binary()) for x in BLOBS)])

    def __call__(self, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x := values.get(f.name), np.ndarray) else x], f.type) for f in self.types], schema=self.types)


def _groups(batches, name: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of equal ``name`` from sorted batches, one by one."""
    rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
    yield from groupby(rows, key=lambda r: r[name])


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int32)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd"), dtype=np.int32) if n else np.empty(0, np.int32)


def blocks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows of kind TEXT (ids; a: token numbers, b: times, c: distinct tokens of each text) and NAMES (tokens and, in a, their texts)."""
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    lanes = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, size // TASK_BYTES // lanes) * lanes
    kind = docs.schema[id_column].dataType.simpleString()
    dropped = {w.encode(): -1 for w in T.STOPWORDS}

    def run(batches):
        task, cut, make = TaskContext.get().partitionId(), 0, None
        known: dict[bytes, int] = dict(dropped)
        names: list[bytes] = []
        ids, at, times, ends, df, part, entries = [], [], [], [], np.zeros(0, np.int64), 0, 0

        def chunk():
            nonlocal ids, at, times, ends, df, part, entries
            index, count = np.array(at, dtype=np.int32), np.array(times, dtype=np.int32)
            keep = index >= 0
            before = np.concatenate([[0], np.cumsum(keep)])
            counts = np.diff(before[np.array([0, *ends])]).astype(np.int32)
            index, count = index[keep], count[keep]
            df = np.pad(df, (0, len(names) - len(df))) + np.bincount(index, minlength=len(names))
            out = make(block=task + cut * tasks, kind=TEXT, part=part, ids=ids, a=_packed(index), b=_packed(count), c=counts)
            part, entries = part + 1, entries + len(index)
            ids, at, times, ends = [], [], [], []
            return out

        def close():
            nonlocal known, names, df, part, entries, cut
            for i in range(0, len(names), 1 << 16):
                some = [w.decode("utf-8", "replace") for w in names[i : i + (1 << 16)]]
                yield make(block=task + cut * tasks, kind=NAMES, part=i, tokens=some, a=df[i : i + (1 << 16)])
            known, names, df, part, entries, cut = dict(dropped), [], np.zeros(0, np.int64), 0, 0, cut + 1

        for b in batches:
            make = make or Rows(b.schema.field(0).type)
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(text.translate(SPACES).split())
                numbers = list(map(known.get, found))
                if None in numbers:
                    for i, word in enumerate(found):
                        if numbers[i] is None:
                            if len(word) < 2 or len(word) < 5 and len(word.decode("utf-8", "replace")) < 2:
                                known[word] = -1
                            else:
                                known[word] = len(names)
                                names.append(word)
                            numbers[i] = known[word]
                ids.append(key)
                at += numbers
                times += found.values()
                ends.append(len(at))
                if len(at) >= CHUNK or len(ids) >= TEXTS:
                    yield chunk()
                    if len(names) >= BLOCK_TOKENS or entries >= BLOCK_ENTRIES:
                        yield from close()
        if ids:
            yield chunk()
        if part:
            yield from close()

    texts = docs.select(id_column, F.lower(F.coalesce(F.col(text_column), F.lit(""))).cast("binary").alias("text")).coalesce(tasks)
    return written(texts.mapInArrow(released(run), schema(kind)))


def names(table: DataFrame) -> DataFrame:
    """block, at (the token's number there), token, df (of its texts there)."""

    def run(batches):
        for b in batches:
            for block, part, some, df in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(part, part + n, dtype=np.int32)), pa.array(some, pa.string()), pa.array(np.frombuffer(df, np.int64))], ["block", "at", "token", "df"])

    return table.where(F.col("kind") == NAMES).select("block", "part", "tokens", "a").mapInArrow(released(run), "block long, at int, token string, df long")


def _dealt(rows: DataFrame, name: str, n: int) -> DataFrame:
    return rows.repartitionById(n, F.col(name).cast("int")).sortWithinPartitions(name, "kind", "part", "q", "block")


def spread(table: DataFrame) -> int:
    return (table.agg(F.max("block")).first()[0] or 0) + 1


def routes(table: DataFrame, parts: int, id_type: str) -> DataFrame:
    """How tokens and blocks meet.

    NAMES (q): tokens of several blocks, and for each block that has them a: place
    here, b: number there, c: block; d: their texts.  ROUTE (block, q) and LOCAL
    (block): a: numbers, b: texts, of tokens of several blocks and of this one.
    """

    def run(batches):
        make = Rows(pa.int64())
        for q, held in _parts(batches):
            block, at, df = (held.column(x).to_numpy() for x in ("block", "at", "df"))
            token = held.column("token").combine_chunks()
            n = len(block)
            new = np.ones(n, dtype=bool)
            if n > 1:
                new[1:] = pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            length, total = np.diff([*start, n]), np.add.reduceat(df, start)
            run_of = np.cumsum(new) - 1
            several = length > 1
            place = (np.cumsum(several) - 1).astype(np.int32)
            for shared in (False, True):
                rows = np.flatnonzero(several[run_of] == shared)
                rows = rows[np.argsort(block[rows], kind="stable")]
                found, first = np.unique(block[rows], return_index=True)
                for k, some in zip(found.tolist(), np.split(rows, first[1:]), strict=False):
                    texts = None if shared else token.take(pa.array(some)).to_pylist()
                    yield make(block=k, q=q, kind=ROUTE if shared else LOCAL, part=q, tokens=texts, a=at[some].astype(np.int32), b=total[run_of[some]])
                if shared and len(rows):
                    mine = token.take(pa.array(start[several])).to_pylist()
                    yield make(block=-1, q=q, kind=NAMES, part=0, tokens=mine, a=place[run_of[rows]], b=at[rows].astype(np.int32), c=block[rows], d=total[several])

    dealt = names(table).withColumn("q", F.expr(f"cast(pmod(xxhash64(token), {parts}) as int)")).repartitionById(parts, F.col("q")).sortWithinPartitions("q", "token", "block")
    return written(_ids_as(dealt.mapInArrow(released(run), schema("bigint")), id_type))


def _parts(batches) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each part of the vocabulary, whole: it is small by choice."""
    held, last = [], None
    for b in batches:
        q = b.column(b.schema.get_field_index("q")).to_numpy()
        for some in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
            if len(some):
                if held and q[some[0]] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = int(q[some[0]])
                held.append(b.slice(int(some[0]), len(some)))
    if held:
        yield last, pa.Table.from_batches(held)


def _ids_as(rows: DataFrame, id_type: str) -> DataFrame:
    """Rows without ids, in the layout of a corpus's."""
    return rows.withColumn("ids", F.lit(None).cast(f"array<{id_type}>"))


class Block:
    """A block's rows as they come: weights of its tokens, and its texts chunk by chunk; tokens' vectors hold the numbers of ``cut``."""

    def __init__(self, rows: Iterator[dict], cut: slice, n_docs: int, turn: np.ndarray, direction: Callable | None = None):
        """``turn`` is what the rows' vectors still lack; without a ``direction`` local tokens follow from them."""
        self.k, self.cut = cut.stop - cut.start, cut
        self.v, self.idf = np.zeros((0, self.k)), np.zeros(0)
        self.local, self.local_tokens = np.zeros(0, dtype=np.int32), []
        self.shared: list[tuple[int, np.ndarray]] = []
        self.old: dict[int, np.ndarray] = {}
        self.texts: list[dict] = []
        local = []
        for r in rows:
            if r["kind"] in (LOCAL, ROUTE):
                at, df = _ints(r["a"]), np.frombuffer(r["b"], np.int64)
                self._reach(at)
                self.idf[at] = np.log((1 + n_docs) / (1 + df)) + 1
                if r["kind"] == LOCAL:
                    local.append(at)
                    self.local_tokens += r["tokens"]
                else:
                    self.shared.append((r["q"], at))
                    if r["v"] is not None:
                        self.v[at] = np.frombuffer(r["v"]).reshape(-1, self.k)
            elif r["kind"] == OLD:
                y = np.frombuffer(r["v"]).reshape(len(r["ids"]), -1)
                part = y @ turn[r["q"] : r["q"] + y.shape[1]]
                self.old[r["part"]] = self.old[r["part"]] + part if r["part"] in self.old else part
            elif r["kind"] == TEXT:
                r["counts"] = _ints(r["c"])
                self.texts.append(r)
        if local:
            self.local = np.concatenate(local)
        if direction is not None:
            for at, token in zip(self.local.tolist(), self.local_tokens, strict=True):
                self.v[at] = direction(token, turn.shape[0])[cut]

    def _reach(self, at: np.ndarray) -> None:
        most = int(at.max(initial=-1)) + 1
        if most > len(self.idf):  # pages that nothing touches cost nothing
            room = max(most, 2 * len(self.idf), 1 << 12)
            self.idf = np.pad(self.idf, (0, room - len(self.idf)))
            wide = np.zeros((max(room, BLOCK_TOKENS), self.k)) if len(self.v) < room else self.v
            if wide is not self.v:
                wide[: len(self.v)] = self.v
                self.v = wide

    def entries(self, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token numbers, weights, rows with tokens, where they start) of a chunk."""
        counts = r["counts"]
        at, times = (_unpacked(r[x], int(counts.sum())) for x in ("a", "b"))
        if at.max(initial=-1) >= len(self.idf):
            self._reach(at)
        rows = np.flatnonzero(counts)
        starts = np.cumsum(counts[rows]) - counts[rows]
        n = np.add.reduceat(times, starts, dtype=np.int64) if len(rows) else np.empty(0)
        return at, times / np.repeat(n, counts[rows]) * self.idf[at], rows, starts

    def product(self, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's rows times the tokens' vectors; whether a row has a known token."""
        at, w, rows, starts = self.entries(r)
        y, known = np.zeros((len(r["counts"]), self.k)), np.zeros(len(r["counts"]), dtype=bool)
        if len(rows):
            known[rows] = np.maximum.reduceat(w, starts) > 0
            for i, j in _strips(starts, len(at)):
                a, b = starts[i], starts[j] if j < len(starts) else len(at)
                y[rows[i:j]] = np.add.reduceat(self.v[at[a:b]] * w[a:b, None], starts[i:j] - a, axis=0)
        return y, known

    def transposed(self, only: np.ndarray | None = None) -> np.ndarray:
        """The sums of weight times the row's ``old`` vector, of all tokens or the given ones."""
        place = None
        if only is not None:
            place = np.full(len(self.idf), -1, dtype=np.int32)
            place[only] = np.arange(len(only))
        z = np.zeros((len(self.idf) if only is None else len(only), self.k))
        for r in self.texts:
            at, w, rows, _ = self.entries(r)
            row = np.repeat(rows, r["counts"][rows])
            keep = np.flatnonzero(w)
            at, w, row = at[keep], w[keep], row[keep]
            if place is not None:
                keep = np.flatnonzero(place[at] >= 0)
                at, w, row = place[at[keep]], w[keep], row[keep]
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, w, row = at[order], w[order], row[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            y = np.ascontiguousarray(self.old[r["part"]][:, self.cut])
            for i, j in _strips(starts, len(at)):
                a, b = starts[i], starts[j] if j < len(starts) else len(at)
                z[at[starts[i:j]]] += np.add.reduceat(y[row[a:b]] * w[a:b, None], starts[i:j] - a, axis=0)
        return z


def _strips(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Runs of segments that hold about STRIP entries."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRIP, side="right")) - 1) if starts[i] + STRIP < n else len(starts)
        yield i, j
        i = j


def slices(k: int) -> list[slice]:
    return [slice(i, min(i + SLICE, k)) for i in range(0, k, SLICE)]


def start(table: DataFrame, k: int, cut: slice, direction: Callable) -> DataFrame:
    """The first vectors of the tokens of several blocks."""

    def run(batches):
        make = Rows(pa.int64())
        for _, rows in _groups(batches, "q"):
            for r in rows:
                yield make(**r | {"v": np.array([direction(t, k)[cut] for t in r["tokens"]])})

    return _ids_as(table.where(F.col("kind") == NAMES), "bigint").mapInArrow(released(run), schema("bigint"))


def messages(vectors: DataFrame, cut: slice, id_type: str) -> DataFrame:
    """ROUTE rows with the vectors of the tokens that a block has."""

    def run(batches):
        make = Rows(pa.int64())
        for q, rows in _groups(batches, "q"):
            for r in rows:
                place, at, block, df = _ints(r["a"]), _ints(r["b"]), np.frombuffer(r["c"], np.int64), np.frombuffer(r["d"], np.int64)
                v = np.frombuffer(r["v"]).reshape(-1, cut.stop - cut.start)
                found, first = np.unique(block, return_index=True)
                for m, some in zip(found.tolist(), np.split(np.arange(len(block)), first[1:]), strict=False):
                    yield make(block=m, q=q, kind=ROUTE, part=q, a=at[some], b=df[place[some]], v=v[place[some]])

    return _ids_as(vectors.mapInArrow(released(run), schema("bigint")), id_type)


def project(rows: DataFrame, n: int, cut: slice, n_docs: int, turn: np.ndarray, id_type: str, direction: Callable | None = None) -> DataFrame:
    """OLD rows: numbers of the texts' vectors (ids, v, from number q on; c: whether a token is known).

    From TEXT and LOCAL rows, messages and all OLD rows of the step before, which lack
    ``turn``; g holds the products of those rows' whole vectors with the new numbers.
    """
    ids = _arrow(id_type)

    def run(batches):
        make = Rows(ids)
        for block, found in _groups(batches, "block"):
            m = Block(found, cut, n_docs, turn, direction)
            if m.old:
                m.v[m.local] = m.transposed(m.local)
            for r in m.texts:
                y, known = m.product(r)
                g = m.old[r["part"]].T @ y if m.old else None
                yield make(block=block, q=cut.start, kind=OLD, part=r["part"], ids=r["ids"], c=known.astype(np.uint8), v=y, g=g)
            del m

    return written(_dealt(rows, "block", n).mapInArrow(released(run), schema(id_type)))


def _arrow(id_type: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(id_type))


def gather(rows: DataFrame, held: DataFrame, n: int, parts: int, cut: slice, n_docs: int, turn: np.ndarray) -> DataFrame:
    """Numbers of the vectors of the tokens of several blocks, from TEXT, ROUTE and OLD rows, which lack ``turn``; ``held`` has their places."""

    def sums(batches):
        make = Rows(pa.int64())
        for block, found in _groups(batches, "block"):
            m = Block(found, cut, n_docs, turn)
            z = m.transposed()
            for q, at in m.shared:
                yield make(block=block, q=q, kind=ROUTE, part=0, v=z[at])
            del m, z

    def add(batches):
        make = Rows(pa.int64())
        for _, found in _groups(batches, "q"):
            for r in found:  # the places come first
                if r["kind"] == NAMES:
                    row, place, block = r, _ints(r["a"]), np.frombuffer(r["c"], np.int64)
                    v = np.zeros((len(r["tokens"]), cut.stop - cut.start))
                else:
                    i, j = np.searchsorted(block, [r["block"], r["block"] + 1])
                    v[place[i:j]] += np.frombuffer(r["v"]).reshape(-1, v.shape[1])
            yield make(**row | {"part": cut.start, "v": v})

    partial = _dealt(rows, "block", n).mapInArrow(released(sums), schema("bigint"))
    places = _ids_as(held.where(F.col("kind") == NAMES), "bigint")
    return written(_dealt(partial.unionByName(places), "q", parts).mapInArrow(released(add), schema("bigint")))


def gram(rows: list[DataFrame], cuts: list[slice], k: int) -> np.ndarray:
    """The products of the tokens' vectors of a step: those of the texts' vectors before and after it."""
    total = np.zeros((k, k))
    for df, cut in zip(rows, cuts, strict=True):
        for r in df.select("g").toLocalIterator():
            total[:, cut] += np.frombuffer(r.g).reshape(k, -1)
    return (total + total.T) / 2


def _whole(rows: list[DataFrame], n: int) -> DataFrame:
    return _dealt(functools.reduce(DataFrame.unionByName, rows), "block", n)


def _joined(found: Iterator[dict], name: str) -> Iterator[tuple[dict, np.ndarray]]:
    """A row of each ``part``, or ``q``, with the numbers of all its slices."""
    for _, some in groupby(found, key=lambda r: r[name]):
        some = list(some)
        n = len(some[0]["ids"] if some[0]["kind"] == OLD else some[0]["tokens"])
        yield some[0], np.concatenate([np.frombuffer(r["v"]).reshape(n, -1) for r in some], axis=1)


def products(rows: list[DataFrame], n: int, k: int, turn: np.ndarray) -> np.ndarray:
    """The products of the numbers of all texts' vectors."""

    def run(batches):
        total = np.zeros((k, k))
        for _, found in _groups(batches, "block"):
            for _, v in _joined(found, "part"):
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    total = sum((np.frombuffer(r.g).reshape(k, k) for r in _whole(rows, n).mapInArrow(released(run), "g binary").toLocalIterator()), np.zeros((k, k)))
    return turn.T @ total @ turn


def columns(vectors: list[DataFrame], rows: DataFrame, n: int, parts: int, k: int, n_docs: int, before: np.ndarray, turn: np.ndarray, direction: Callable | None = None) -> DataFrame:
    """token, column: the vectors of all tokens after ``turn``; ``rows`` as for ``project``, without messages."""

    def out(tokens, v):
        v = v @ turn
        ends = pa.array(np.arange(0, v.size + 1, k, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))], ["token", "column"])

    def shared(batches):
        for _, found in _groups(batches, "q"):
            for r, v in _joined(found, "q"):
                yield out(r["tokens"], v)

    def own(batches):
        for _, found in _groups(batches, "block"):
            m = Block(found, slice(0, k), n_docs, before, direction)
            v = m.transposed(m.local) if m.old else m.v[m.local]
            for i in range(0, len(m.local), 1 << 14):
                yield out(m.local_tokens[i : i + (1 << 14)], v[i : i + (1 << 14)])
            del m, v

    kind = "token string, column array<double>"
    several = _dealt(functools.reduce(DataFrame.unionByName, vectors), "q", parts).mapInArrow(released(shared), kind)
    return several.unionByName(_dealt(rows, "block", n).mapInArrow(released(own), kind))


def known(table: DataFrame, model: DataFrame, cut: slice, id_type: str) -> DataFrame:
    """ROUTE rows for a corpus's blocks from a model's columns (token, df, column)."""
    asked = names(table).select("block", "at", "token")
    if asked.count() <= BROADCAST_TOKENS:
        asked = F.broadcast(asked)
    found = model.select("token", "df", "column").join(asked, "token").select("block", "at", "df", F.slice("column", cut.start + 1, cut.stop - cut.start).alias("column"))

    def run(batches):
        make = Rows(pa.int64())
        for b in batches:
            block, at, df = (b.column(i).to_numpy() for i in range(3))
            v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, cut.stop - cut.start)
            for m in np.unique(block).tolist():
                some = np.flatnonzero(block == m)
                yield make(block=m, kind=ROUTE, part=0, a=at[some].astype(np.int32), b=df[some], v=v[some])

    return _ids_as(found.mapInArrow(released(run), schema("bigint")), id_type)


def vectors(rows: list[DataFrame], n: int, k: int, id_column: str, id_type: str, turn: np.ndarray, unknown: np.ndarray) -> DataFrame:
    """id, embedding: unit vectors of projected rows after ``turn``; a text without a known token gets ``unknown``."""
    ids = _arrow(id_type)

    def run(batches):
        for _, found in _groups(batches, "block"):
            for r, v in _joined(found, "part"):
                v, has = v @ turn, np.frombuffer(r["c"], np.uint8).astype(bool)
                size = np.linalg.norm(v, axis=1)
                v[size > 0] /= size[size > 0, None]
                v[~has] = unknown
                ends = pa.array(np.arange(0, v.size + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], ids), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))], [id_column, "embedding"])

    return _whole(rows, n).mapInArrow(released(run), f"{id_column} {id_type}, embedding array<double>")
