"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Equal vectors of a label are one class; links are found between classes and
counted with their sizes.  A bounded sample of unit vectors gives the principal
axes and, by iterative quantisation, rotations; the signs of the projections are
the codes.  No mean is subtracted: bits differ by the angle between the vectors
themselves, the one that the threshold bounds, wherever the vectors lie.  Every
class is indexed: each table cuts its code into bands, and classes that agree in a
whole band of a table meet in a bucket.  Band width grows with the logarithm of
the largest label up to ``WIDEST``, and there are as many tables as it takes for a
pair at the threshold to meet with probability ``RECALL``, however many.

What meets is first compared by Hamming distance: the first codes of a pair at the
threshold differ, by ``SIGMAS`` standard deviations, in no more than a known number
of bits.  Only classes that have such a partner in a bucket are reranked there, by
the cosine of the original vectors in double precision, in blocks; what leaves a
bucket are counts and one edge a class, never pairs.  A pair counts in the first
band in which it meets.

Buckets of over ``CHUNK`` classes are cut into chunks by a hash, and each pair of
chunks is a task's worth of work of its own, so no hot bucket sits in one task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of different
length link with nothing; rows that repeat a vec_id are separate vectors that
share an id; a null vec_id takes part but never names a component; an empty table
gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared
from lodestore.llm.components import components

#: The most numbers and vectors that the rotations are learnt from.
SAMPLE_NUMBERS, SAMPLE_VECTORS = 1 << 21, 20_000
CODE_BITS = 64
RECALL = 0.995
CHUNK = 1024
#: Buckets up to this size are reranked together.
FEW = 48
#: The widest band: a wider one would need tables without end.
WIDEST = 24
#: The codes that are compared, and by how much a pair's bits may differ from what its angle makes likely.
COMPARED, SIGMAS = 4, 5


def learn(sample: np.ndarray, tables: int, bits: int, rounds: int = 50, seed: int = 7) -> np.ndarray:
    """Per table a matrix; the signs of the products with it are the code."""
    _, _, axes = np.linalg.svd(sample.T @ sample, hermitian=True)
    axes = axes[:bits].T
    v = sample @ axes
    random = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        rotation = np.linalg.qr(random.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            rotation = (left @ right).T
        out.append(axes @ rotation)
    return np.stack(out)


def encode(unit: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """Codes, one column a table."""
    weights = np.uint64(1) << np.arange(projections.shape[2], dtype=np.uint64)
    return np.stack([((unit @ p >= 0) * weights).sum(axis=1, dtype=np.uint64) for p in projections], axis=1)


def band_keys(codes: np.ndarray, width: int, bands: int) -> np.ndarray:
    """Per row and table the bands' values, in the order in which pairs are looked for."""
    mask = np.uint64((1 << width) - 1)
    return np.concatenate([(codes >> np.uint64(width * k) & mask) for k in range(bands)], axis=1).astype(np.int64)


def plan(largest: int, bits: int, threshold: float) -> tuple[int, int, int]:
    """(band width, bands a table, tables)."""
    width = min(bits, WIDEST, max(8, math.ceil(math.log2(max(2, largest)))))
    bands = max(1, bits // width)
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, bands, math.ceil(math.log(1 - RECALL) / (bands * math.log(1 - same)))


def most_apart(bits: int, threshold: float) -> float:
    """The most of so many bits in which vectors at the threshold differ."""
    share = math.acos(threshold) / math.pi
    return bits * share + SIGMAS * math.sqrt(bits * share * (1 - share))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their class, null where a vector can't link; classes)."""
    v = vectors.select(F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.expr("label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(e, x -> x <> 0)")
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    key = F.unhex(F.concat(half(F.xxhash64("label", "e")), half(F.xxhash64("e", "label", F.lit(1)))))
    rows = v.withColumn("cid", F.when(F.coalesce(good, F.lit(False)), key))
    classes = rows.where("cid is not null").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("e").alias("e"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")
    )
    return rows.select("vec_id", "cid"), classes


def unit_rows(lists: list[list[float]]) -> np.ndarray:
    a = np.array(lists, dtype=np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)  # no overflow in the squares
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _near(bucket: np.ndarray, sides: np.ndarray, together, apart) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the rows of one bucket each that are near; rows are sorted by bucket.

    together(a, b): whether these rows are near, for pairs; apart(some, all): for each two rows of these slices.
    """
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(np.append(starts, len(bucket)))
    size = np.repeat(sizes, sizes)
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        fits = (sides[a] == 0) | (sides[a] != sides[b])
        first.append(a[fits])
        second.append(b[fits])

    for k in range(1, min(FEW, int(sizes.max())) if len(sizes) else 0):  # small buckets, all at once
        a = np.flatnonzero((bucket[:-k] == bucket[k:]) & (size[:-k] <= FEW))
        near = together(a, a + k)
        keep(a[near], a[near] + k)
    for start, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        for at in range(start, start + n, 512):
            a, b = np.nonzero(apart(slice(at, min(at + 512, start + n)), slice(start, start + n)))
            a, b = a + at, b + start
            keep(a[a < b], b[a < b])
    return np.concatenate(first), np.concatenate(second)


def _count_and_join(a, b, place, keys, sizes):
    """(links counted here, row that stands for the component) for each row."""
    n = len(keys)
    here = (keys[a] == keys[b]).argmax(axis=1) == place[a]  # not met in an earlier band
    x, y = a[here], b[here]
    counted = np.bincount(x, weights=sizes[y], minlength=n) + np.bincount(y, weights=sizes[x], minlength=n)
    tops = np.arange(n)
    while len(a):
        before, least = tops.copy(), np.minimum(tops[a], tops[b])
        np.minimum.at(tops, a, least)
        np.minimum.at(tops, b, least)
        tops = tops[tops]
        if (tops == before).all():
            break
    return counted.astype(np.int64), tops


def link_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors)
    classes = _shared.written(classes)
    shapes = classes.groupBy("label", F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("d").agg(F.max("n").alias("n")).orderBy("d").collect()  # one row a vector length
    found = None
    for shape in shapes:
        part = _links_of_length(spark, classes.where(F.size("e") == shape.d), shape.d, shape.n, threshold)
        found = part if found is None else found.unionByName(part)
    named = classes.select("cid", "rep", "m")
    if found is None:
        per_class = named.select("cid", "rep", F.lit(0).cast("long").alias("n_links"))
    else:
        found = _shared.written(found)
        roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct())
        members = named.join(roots, named.cid == roots.node).select("cid", "root", "rep")
        first = members.groupBy("root").agg(F.min("rep").alias("first"))
        first = members.join(first, "root").select("cid", "first")
        counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
        per_class = named.join(counts, "cid", "left").join(first, "cid", "left").select(
            "cid", F.coalesce("first", "rep").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")
        )
    linked = rows.where("cid is not null").join(per_class, "cid", "left")
    alone = rows.where("cid is null").withColumn("rep", F.lit(None).cast(vectors.schema["vec_id"].dataType)).withColumn("n_links", F.lit(0).cast("long"))
    out = linked.unionByName(alone).withColumn("component_id", F.coalesce("rep", "vec_id").cast("long"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links_of_length(spark: SparkSession, classes: DataFrame, length: int, largest: int, threshold: float) -> DataFrame:
    bits = min(CODE_BITS, length)
    width, bands, tables = plan(largest, bits, threshold)
    most = max(64, min(SAMPLE_VECTORS, SAMPLE_NUMBERS // length))
    sample = classes.select("cid", "e").orderBy(F.xxhash64("cid")).limit(most).collect()
    model = spark.sparkContext.broadcast(learn(unit_rows([r.e for r in sorted(sample)]), tables, bits))

    def index(batches):
        projections = model.value
        for b in batches:
            if not b.num_rows:
                continue
            unit = unit_rows(b.column(2).to_pylist())
            codes = encode(unit, projections)
            keys = band_keys(codes, width, bands)
            each = [keys[:, k] + (np.int64(k) << np.int64(40)) for k in range(keys.shape[1])]
            ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(each, axis=1).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1).cast(pa.string()), listed, pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(3)],
                ["cid", "label", "keys", "unit", "codes", "m"],
            )

    indexed = _shared.written(classes.select("cid", "label", "e", "m").mapInArrow(_shared.released(index), "cid binary, label string, keys array<long>, unit binary, codes binary, m long"))
    compared = min(COMPARED, tables)
    limit = most_apart(compared * bits, threshold)
    names = ["label", "key", "i", "j"]

    def blocks(slots: DataFrame, values: DataFrame) -> DataFrame:
        """Slots (cid, label, key) of buckets with company, in pairs of chunks, with the classes' values."""
        sizes = slots.groupBy("label", "key").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
        placed = (
            slots.join(sizes.select("label", "key", F.ceil(F.col("g") / CHUNK).cast("int").alias("c")), ["label", "key"])
            .withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("c")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, c - 1)")))
            .select("cid", "label", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
        )
        # side 0: pairs within; 1 and 2: pairs across only
        placed = placed.withColumn("side", F.expr("case when i = j then 0 when mine = i then 1 else 2 end")).drop("mine")
        return placed.join(values, "cid").repartition(*names).sortWithinPartitions(*names)

    def sorted_buckets(table: pa.Table) -> np.ndarray:
        marks = [table.column(c).to_numpy() for c in ("key", "i", "j")] + [table.column("label").to_pandas().factorize()[0]]
        change = np.zeros(table.num_rows, dtype=bool)
        for m in marks:
            change[1:] |= m[1:] != m[:-1]
        return np.cumsum(change)

    def numbers(table: pa.Table, column: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=kind).reshape(table.num_rows, -1)

    def screen(batches):
        for table in _shared.whole_groups(batches, names):
            codes = numbers(table, "sign", np.uint64)
            signs = np.unpackbits(codes.view(np.uint8), axis=1).astype(np.float32) * 2 - 1  # unused bits agree
            wide = signs.shape[1]
            a, b = _near(
                sorted_buckets(table), table.column("side").to_numpy(), lambda x, y: np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1) <= limit,
                lambda x, y: (wide - signs[x] @ signs[y].T) / 2 <= limit + 0.25,
            )
            live = np.unique(np.concatenate([a, b]))
            yield from table.select(["cid", "label", "key"]).take(pa.array(live)).to_batches()

    def rerank(batches):
        for table in _shared.whole_groups(batches, names):
            n = table.num_rows
            units, codes = numbers(table, "unit", np.float64), numbers(table, "codes", np.uint64)
            a, b = _near(
                sorted_buckets(table), table.column("side").to_numpy(), lambda x, y: np.einsum("ij,ij->i", units[x], units[y]) >= threshold, lambda x, y: units[x] @ units[y].T >= threshold
            )
            fits = np.bitwise_count(codes[a, :compared] ^ codes[b, :compared]).sum(axis=1) <= limit  # in every bucket the same pairs count
            counted, tops = _count_and_join(a[fits], b[fits], table.column("key").to_numpy() >> 40, band_keys(codes, width, bands), table.column("m").to_numpy())
            live = np.flatnonzero((counted > 0) | (tops != np.arange(n)))
            ids = table.column("cid").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(live)), pa.array(counted[live]), ids.take(pa.array(tops[live]))], ["cid", "links", "root"])

    slots = indexed.select("cid", "label", F.explode("keys").alias("key"))
    signs = indexed.select("cid", F.substring("codes", 1, 8 * compared).alias("sign"))
    met = _shared.written(blocks(slots, signs).mapInArrow(_shared.released(screen), "cid binary, label string, key long").distinct())
    return blocks(met, indexed.select("cid", "unit", "codes", "m")).mapInArrow(_shared.released(rerank), "cid binary, links long, root binary")


def op2_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
