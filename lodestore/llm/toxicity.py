"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space runs become one space, and a space is put
at either end.  Its features are the distinct n-grams of 3 to 6 code points,
hashed into ``2 ** bits`` cells.  Training computes, per cell, the log of the
ratio of smoothed document frequencies in the two classes, multiplies the
features by it and fits a logistic regression on them.

Defined cases: a null or empty text has no features and gets the score of the
intercept; labels that are null are not used; a doc_id with several labels counts
as toxic if any of them is; repeated rows are scored one by one; without labelled
rows of both classes the model is constant (the share of toxic rows, 0 if none);
ids may be of any type, other columns stay as they are, and an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared

SPACE = re.compile(r"\s+")
ORDERS = (3, 4, 5, 6)
BITS = 18
#: The most labelled rows per class that training reads: those with the smallest id hashes.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
#: The least G squared of a cell that gets a weight: chance alone passes it once in 10,000 cells.
SIGNIFICANT = 15.1
#: Texts up to this many code points are put together before hashing.
CHUNK = 1 << 18
#: Tasks that go through the bounded sample's features.
PARTS = 8


def _groups(texts: list[str | None]):
    """(first index, cleaned texts) of runs of texts of about CHUNK code points together."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        clean = SPACE.sub(" ", (text or "").lower()).strip()
        group.append(f" {clean} " if clean else "")
        size += len(clean)
        if size >= CHUNK:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def _occurrences(group: list[str], bits: int):
    """For each order: the text index and the cell of every n-gram."""
    lengths = np.array([len(x) for x in group], dtype=np.int64)
    points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(group), dtype=np.uint32), lengths)
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(points):
            return
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in ORDERS:
            inside = owner[: len(h)] == owner[n - 1 :]  # no n-gram spans two texts
            cell = ((h ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
            yield owner[: len(h)], cell.astype(np.uint32), inside


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(cells, ends): the distinct cells of each text one after another, and where each text's end."""
    out, counts = [], [np.empty(0, np.int64)]
    for _, group in _groups(texts):
        keys = [(o[i].astype(np.uint64) << np.uint64(bits)) | c[i] for o, c, i in _occurrences(group, bits)]
        found = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        out.append((found & np.uint64((1 << bits) - 1)).astype(np.uint32))
        counts.append(np.bincount((found >> np.uint64(bits)).astype(np.int64), minlength=len(group)))
    return (np.concatenate(out) if out else np.empty(0, np.uint32)), np.cumsum(np.concatenate(counts))


def log_ratios(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells that get a weight, their log-count ratios): cells whose class frequencies differ by more than chance."""
    n = toxic + clean
    ratio = np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1))
    part = lambda a, e: a * np.log(np.maximum(a, 1e-12) / np.maximum(e, 1e-12))
    g2 = 2 * (part(pos, (pos + neg) * toxic / n) + part(neg, (pos + neg) * clean / n))
    live = np.flatnonzero(g2 >= SIGNIFICANT)
    return live, ratio[live]


def descend(found: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 200, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights (the ratios included) and intercept of a logistic regression, by full-batch gradient steps with momentum.

    found: for each text the numbers of the weighted cells that it holds.
    """
    n, size = len(found), len(ratio)
    at, owner = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), [len(f) for f in found])
    value = ratio[at]
    w, bias = np.zeros(size), prior
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=value * w[at], minlength=n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        gw = np.bincount(at, weights=value * g[owner], minlength=size) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.01 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w * ratio, float(bias)


def score(texts: list[str | None], weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """The probability of label 1 for each text: every n-gram is looked up, distinct cells count once."""
    z = np.full(len(texts), bias, dtype=np.float64)
    live = weights != 0
    for first, group in _groups(texts):
        keys = [np.empty(0, np.uint64)]
        for o, c, inside in _occurrences(group, bits):
            hit = np.flatnonzero(live[c] & inside)
            keys.append((o[hit].astype(np.uint64) << np.uint64(bits)) | c[hit])
        found = np.unique(np.concatenate(keys))
        values = weights[(found & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.float64)
        z[first : first + len(group)] += np.bincount((found >> np.uint64(bits)).astype(np.int64), weights=values, minlength=len(group))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[np.ndarray, float]:
    """The model learnt from the labelled rows outside the held-out fold.

    At most ``max_toxic`` and ``max_clean`` rows are read, those whose ids have
    the smallest hashes; of an id's texts the one of the smallest hash.  Texts with
    the same features count once, as toxic if one of them is.  The executors make
    the features, count them by class, and keep those that get a weight; the fit
    runs in one task over these, and the driver gets the weights.
    """
    spark = docs.sparkSession
    marked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
        .where(_shared.fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    chosen = (
        marked.where("toxic = 1").orderBy("order", "doc_id").limit(max_toxic)
        .unionByName(marked.where("toxic = 0").orderBy("order", "doc_id").limit(max_clean)).drop("order")
    )
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))

    def extract(batches):
        for b in batches:
            for low in range(0, b.num_rows, 64):
                part = b.slice(low, 64)
                cells, ends = features(part.column(1).to_pylist())
                rows = [cells[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["row", "toxic", "digest", "cells"])

    named = texts.select(F.col("doc_id").cast("string").alias("row"), "text", "toxic")
    found = _shared.written(named.mapInArrow(_shared.released(extract), "row string, toxic int, digest binary, cells binary"))
    once = found.groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min("row").alias("row")).collect()  # the bounds above
    marks = {r.row: int(r.toxic == 1) for r in once}
    toxic = sum(marks.values())
    clean = len(marks) - toxic
    share = toxic / len(marks) if marks else 0.0
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not toxic or not clean:
        _shared.discard(found)
        return np.zeros(1 << BITS, np.float32), prior
    shared = spark.sparkContext.broadcast(marks)

    def counted(batches):
        counts = np.zeros((2, 1 << BITS), dtype=np.uint32)
        for b in batches:
            for row, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if row in shared.value:
                    counts[shared.value[row], np.frombuffer(cells.as_buffer(), np.uint32)] += 1  # distinct within a text
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    few = found.coalesce(PARTS).select("row", "cells")
    counts = sum(np.frombuffer(r.counts, np.uint32).reshape(2, -1).astype(np.int64) for r in few.mapInArrow(_shared.released(counted), "counts binary").collect())
    live, ratio = log_ratios(counts[1].astype(float), counts[0].astype(float), toxic, clean)
    slots = np.full(1 << BITS, -1, np.int32)
    slots[live] = np.arange(len(live))
    weighted = spark.sparkContext.broadcast((slots, ratio))

    def kept(batches):
        for b in batches:
            rows = [r for r in zip(b.column(0).to_pylist(), b.column(1), strict=True) if r[0] in shared.value]
            at = [weighted.value[0][np.frombuffer(x.as_buffer(), np.uint32)] for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([x[x >= 0].tobytes() for x in at], pa.binary())], ["row", "slots"])

    def learn(batches):
        rows: dict[str, bytes] = {}
        for b in batches:
            rows.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        names = sorted(rows)
        weights, bias = descend([np.frombuffer(rows[r], np.int32) for r in names], np.array([shared.value[r] for r in names]), weighted.value[1], prior)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    small = few.mapInArrow(_shared.released(kept), "row string, slots binary")
    told = small.repartition(1).mapInArrow(_shared.released(learn), "weights binary, bias double").collect()[0]
    _shared.discard(found)
    full = np.zeros(1 << BITS, np.float32)
    full[live] = np.frombuffer(bytes(told.weights), "<f4")
    return full, told.bias


def classify(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and the score of the text of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the input

    def run(batches):
        weights, bias = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(texts, weights, bias))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_shared.released(run), f"doc_id {kind}, score double")


def reject(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for b in batches:
            clean = score(b.column("text").to_pylist(), weights, bias) < threshold
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(_shared.released(run), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    model = train(docs, _shared.table(spark, sf_dir, "labels"))
    scored = classify(docs, model)
    return scored.select(
        "doc_id", (_shared.fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
