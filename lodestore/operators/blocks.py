"""Similarity by matrix products: blocks of vectors against blocks of vectors, nothing but answers leaves a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The most query vectors, and numbers in them, that are broadcast; more are dealt to cells beside the corpus.
BROADCAST_QUERIES, BROADCAST_NUMBERS = 4096, 1 << 22
#: Rows of a corpus cell, rows of a product, and rows of a chunk of a group.
CELL, STRIP, CHUNK = 1 << 14, 2048, 2048


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors in double precision) of the rows that have the most common length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.array(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes > 0)
    if not len(rows):
        return rows, np.empty((0, 0))
    length = np.bincount(sizes[rows]).argmax()
    rows = np.flatnonzero(sizes == length)
    return rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)


class Best:
    """The k best rows of each query so far: highest score first, lower id on ties."""

    def __init__(self, queries: int, k: int, threshold: float | None):
        self.k, self.least = k, np.full(queries, -np.inf if threshold is None else threshold)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries by rows."""
        least = self.least
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero(scores >= least[:, None])
        self.parts.append((q, scores[q, r], ids[r]))
        self.held += len(q)
        if self.held > 4 * self.k * len(self.least) + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, i = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.searchsorted(q, np.arange(len(self.least)))
        place = np.arange(len(q)) - starts[q] if len(q) else q
        keep = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        self.parts, self.held = [(q[keep], s[keep], i[keep])], int(keep.sum())
        return self.parts[0]


FOUND = "query_id {}, vec_id {}, score double"


def top_k(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank of each query's k best rows by the product of the vectors.

    A stated set of queries (query_id, qv) meets all rows (vec_id, embedding) in
    blocks.  Up to ``BROADCAST_QUERIES`` queries, counted first, are broadcast
    and every task keeps k rows a query; more are dealt to cells of both tables,
    so neither side is held whole anywhere.  Vectors of another length than the
    queries', null ones and null ids match nothing.
    """
    spark = corpus.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), corpus.schema["vec_id"].dataType.simpleString()]
    schema, (kind_q, kind_v) = FOUND.format(*kinds), kinds
    asked = queries.select("query_id", F.col("qv").cast("array<double>").alias("qv")).where("query_id is not null and size(qv) > 0")
    rows = corpus.select("vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    few = asked.limit(BROADCAST_QUERIES + 1).toPandas()

    def answers(best: Best, names: np.ndarray) -> pa.RecordBatch:
        q, s, i = best.cut()
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    def meet(best: Best, asked_of: np.ndarray, ids, lists) -> None:
        at, vectors = matrix(lists)
        if len(at) and vectors.shape[1] == asked_of.shape[1]:
            ids = np.asarray(ids)[at]
            for low in range(0, len(at), STRIP):
                best.add(asked_of @ vectors[low : low + STRIP].T, ids[low : low + STRIP])

    if len(few) <= BROADCAST_QUERIES and few["qv"].map(len).sum() <= BROADCAST_NUMBERS:
        if not len(few):
            return spark.createDataFrame([], f"{schema}, rank int")
        lengths = few["qv"].map(len)
        few = few[lengths == lengths.mode()[0]]
        shared = spark.sparkContext.broadcast((few["query_id"].to_numpy(), np.array(few["qv"].tolist())))

        def scan(batches):
            names, asked_of = shared.value
            best = Best(len(names), k, threshold)
            for b in batches:
                meet(best, asked_of, b.column(0), b.column(1))
            yield answers(best, names)

        found = rows.mapInArrow(scan, schema)
    else:
        cells = max(1, -(-rows.count() // CELL))
        blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
        cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = rows.withColumn("cell", cell("vec_id", cells)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("block", cell("query_id", blocks)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

        def both(corpus_cell: pa.Table, query_block: pa.Table) -> pa.Table:
            at, asked_of = matrix(query_block.column("qv"))
            names = query_block.column("query_id").to_numpy()[at]
            best = Best(len(names), k, threshold)
            if len(names):
                meet(best, asked_of, corpus_cell.column("vec_id").to_numpy(), corpus_cell.column("embedding"))
            return pa.Table.from_batches([answers(best, names)])

        found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(both, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealt(vectors: DataFrame, group: str, *more: str) -> DataFrame:
    """The rows of each group cut into chunks of about ``CHUNK`` by a hash, and dealt to a cell (group, i, j) for each two chunks."""
    sizes = vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    return (
        vectors.select(group, "vec_id", "embedding", *more).where("vec_id is not null").join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, group)
        .withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select(group, "vec_id", "embedding", *more, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    )


def cell_pairs(cell: pa.Table, threshold: float):
    """(vectors, their row numbers, strips of (x, y, sim)): the pairs of different ids of a cell, once each, as numbers of vectors."""
    at, v = matrix(cell.column("embedding"))
    ids, mine = cell.column("vec_id").to_numpy()[at], cell.column("mine").to_numpy()[at]
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)

    def strips():
        for low in range(0, len(left), STRIP):
            x = left[low : low + STRIP]
            sims = v[x] @ v[right].T
            p, q = np.nonzero(sims >= threshold)
            a, b = x[p], right[q]
            keep = ids[a] < ids[b] if i == j else ids[a] != ids[b]
            yield a[keep], b[keep], sims[p, q][keep]

    return v, at, strips()


def similar_pairs(vectors: DataFrame, threshold: float, group: str = "label") -> DataFrame:
    """group, a < b, sim: the pairs of a group whose product reaches the threshold.

    A group is cut into chunks of about ``CHUNK`` rows by a hash and each two chunks
    are multiplied in a task, so a large group is many tasks; only pairs at the
    threshold leave them.
    """
    kind, id_kind = vectors.schema[group].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    def multiply(cell: pa.Table) -> pa.Table:
        _, at, strips = cell_pairs(cell, threshold)
        ids = cell.column("vec_id").to_numpy()[at]
        found = [(ids[:0], ids[:0], np.empty(0)), *((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), s) for x, y, s in strips)]
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({group: pa.array([cell.column(group)[0].as_py()] * len(a), cell.schema.field(group).type), "a": pa.array(a), "b": pa.array(b), "sim": pa.array(s)})

    return dealt(vectors, group).groupBy(group, "i", "j").applyInArrow(multiply, f"{group} {kind}, a {id_kind}, b {id_kind}, sim double")


def neighbour_graph(vectors: DataFrame, threshold: float, most: int | None = None, group: str = "label") -> DataFrame:
    """src, dst, sim: both directions of the similar pairs of a group, of each node the ``most`` nearest."""
    pairs = similar_pairs(vectors, threshold, group)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "sim"))
    if most is None:
        return edges
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")
