"""Chains of two hops over similar vectors, without an edge table: only a group's strongest edges and answers leave a task.

A row of the second hop scores by its best edge from the first hop, so along a
group's edges, strongest first, the first rows that a seed finds are its best.
The edges down to a bound are listed, in a group so many as ``EDGES`` allows; a
seed whose k rows all reach the bound can't find better ones below it.  Seeds that
fall short get a longer list, and those that still do, or whose first hop is short,
meet all rows of their group by matrix products.  Edges between equal vectors are
left out of the lists: a seed's first hop holds both ends or neither.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import decay
from lodestore.operators import blocks

#: The most edges of a group's list, in the first round and the second; in the first ``PER_ROW`` times its rows if that is more.
EDGES, PER_ROW = (1 << 15, 1 << 21), 8
#: Seeds of a task, seeds of a product, and the longest first hop that meets all rows at once.
SEEDS, STRIP, FEW = 4096, 64, 64
#: Steps of the scores at which a list may end.
STEPS = 1024


def _final(value: np.ndarray) -> np.ndarray:
    """``decay.final`` of an array."""
    return np.round(np.clip(value, 0.0, 1.0), 6)


def _steps(value: np.ndarray) -> np.ndarray:
    return np.floor(_final(value) * STEPS).astype(np.int64)


def _kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once; a temporary one only where none is set and all run on one machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestore-checkpoint-"))
    return df.checkpoint()


def _edges(cell: pa.Table, threshold: float):
    """(sources, targets, values) of a cell's edges between different vectors, as row numbers; strip by strip, each direction for itself."""
    v, at, strips = blocks.cell_pairs(cell, threshold)
    weight = cell.column("weight").to_numpy()[at]
    same = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * v.itemsize}").ravel(), return_inverse=True)[1] if v.size else np.empty(0, np.int64)
    for x, y, sim in strips:
        differ = same[x] != same[y]
        x, y, sim = x[differ], y[differ], sim[differ]
        for a, b in ((x, y), (y, x)):
            yield at[a], at[b], sim * weight[b]


def _bounds(dealt: DataFrame, sizes: DataFrame, group: str, threshold: float, turn: int) -> DataFrame:
    """group, least: the step of the scores at which each group's list ends; -1 where it holds all edges."""
    kind = dealt.schema[group].dataType.simpleString()

    def count(cell: pa.Table) -> pa.Table:
        n = np.zeros(STEPS + 1, dtype=np.int64)
        for _, _, value in _edges(cell, threshold):
            n += np.bincount(_steps(value), minlength=STEPS + 1)
        at = np.flatnonzero(n)
        return pa.table({group: pa.array([cell.column(group)[0].as_py()] * len(at), cell.schema.field(group).type), "step": pa.array(at), "n": pa.array(n[at])})

    counted = dealt.groupBy(group, "i", "j").applyInArrow(count, f"{group} {kind}, step long, n long").groupBy(group, "step").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy(group).orderBy(F.desc("step")))  # STEPS + 1 rows a group at most
    most = F.greatest(F.lit(EDGES[turn]), F.col("size") * PER_ROW) if not turn else F.lit(EDGES[turn])
    summed = counted.withColumn("above", above).join(sizes, group).groupBy(group).agg(
        F.when(F.max("above") <= F.max(most), -1).otherwise(F.coalesce(F.min(F.when(F.col("above") <= most, F.col("step"))), F.lit(STEPS + 1))).alias("least")
    )
    return sizes.select(group).join(summed, group, "left").select(group, F.coalesce("least", F.lit(-1)).cast("long").alias("least"))


def _lists(dealt: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, src, dst, value: the edges of each group from its ``least`` step on."""
    kind, id_kind = (dealt.schema[c].dataType.simpleString() for c in (group, "vec_id"))

    def pick(cell: pa.Table) -> pa.Table:
        ids, least = cell.column("vec_id").to_numpy(), cell.column("least")[0].as_py()
        found = [(ids[:0], ids[:0], np.empty(0))]
        for a, b, value in _edges(cell, threshold):
            keep = _steps(value) >= least
            found.append((ids[a[keep]], ids[b[keep]], value[keep]))
        a, b, value = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({group: pa.array([cell.column(group)[0].as_py()] * len(a), cell.schema.field(group).type), "src": pa.array(a), "dst": pa.array(b), "value": pa.array(value)})

    return dealt.groupBy(group, "i", "j").applyInArrow(pick, f"{group} {kind}, src {id_kind}, dst {id_kind}, value double")


def _first(src: np.ndarray, dst: np.ndarray, near: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Places in the list of the first edges from ``near`` to each of the first k rows that are ``new``."""
    found, low, size = [np.empty(0, np.int64)], 0, 1024
    while low < len(src):
        hit = np.flatnonzero(near[src[low : low + size]] & new[dst[low : low + size]])
        if len(hit):
            found.append(hit + low)
            if len(set(dst[np.concatenate(found)].tolist())) >= k:
                break
        low, size = low + size, 2 * size
    at = np.concatenate(found)
    return at[np.sort(np.unique(dst[at], return_index=True)[1])][:k]


def _best(rows: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best values, of equal scores those of the lower rows."""
    score = _final(value)
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return at[np.lexsort((rows[at], -score[at]))][:k]
    return np.lexsort((rows, -score))


def _answers(rows: DataFrame, lists: DataFrame, group: str, threshold: float, k: int, last: bool) -> DataFrame:
    """seed, vec_id, depth, value of the seeds' best rows; a row without vec_id for a seed that the list leaves open."""
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.when(F.col("asked"), 1)) / SEEDS).cast("int").alias("blocks")).where("blocks > 0")
    block = F.explode(F.expr("sequence(0, blocks - 1)"))
    left = rows.join(sizes, group).withColumn("block", block).withColumn("mine", F.col("asked") & (F.pmod(F.xxhash64("vec_id"), F.col("blocks")) == F.col("block"))).drop("asked", "blocks")
    right = lists.join(sizes, group).withColumn("block", block).drop("blocks")

    def meet(members: pa.Table, listed: pa.Table) -> pa.Table:
        at, v = blocks.matrix(members.column("embedding"))
        ids = members.column("vec_id").to_numpy()[at]
        order = np.argsort(ids)
        at, ids, v = at[order], ids[order], v[order]
        weight, mine = members.column("weight").to_numpy()[at], np.flatnonzero(members.column("mine").to_numpy()[at])
        least = members.column("least")[0].as_py()
        src, dst = (np.searchsorted(ids, listed.column(c).to_numpy()) for c in ("src", "dst"))
        value = listed.column("value").to_numpy()
        order = np.lexsort((dst, -_final(value)))
        src, dst, value = src[order], dst[order], value[order]
        out = []
        for low in range(0, len(mine), STRIP):
            sims = v[mine[low : low + STRIP]] @ v.T
            for seed, sim in zip(mine[low : low + STRIP].tolist(), sims, strict=True):
                near = sim >= threshold
                near[seed] = False
                first = np.flatnonzero(near)
                if not len(first):
                    continue
                one = first[_best(first, sim[first] * weight[first], k)]
                new = ~near
                new[seed] = False
                places = _first(src, dst, near, new, k)
                two, gain = dst[places], value[places]

                def together():
                    r, x = np.concatenate([one, two]), np.concatenate([sim[one] * weight[one], gain])  # noqa: B023
                    best = _best(r, x, k)
                    return r[best], np.repeat([1, 2], [len(one), len(two)])[best], x[best]  # noqa: B023

                found = together()
                if least >= 0 and len(two) < k and (len(found[0]) < k or _steps(found[2][-1:])[0] < least):
                    if not last and len(first) > FEW:
                        out.append(([seed], [-1], [0], [np.nan]))
                        continue
                    most = np.full(len(v), -np.inf)
                    for i in range(0, len(first), STRIP):
                        np.maximum(most, np.fmax.reduce(v[first[i : i + STRIP]] @ v.T, axis=0), out=most)
                    two = np.flatnonzero(new & (most >= threshold))
                    two = two[_best(two, most[two] * weight[two], k)]
                    gain = most[two] * weight[two]
                    found = together()
                out.append(([seed] * len(found[0]), *found))
        seeds, r, depth, x = (np.concatenate([c[i] for c in out]) if out else np.empty(0) for i in range(4))
        seeds, r = seeds.astype(np.int64), r.astype(np.int64)
        names = pa.array(ids)
        return pa.table({"seed": names.take(pa.array(seeds)), "vec_id": names.take(pa.array(r, mask=r < 0)), "depth": pa.array(depth.astype(np.int32)), "value": pa.array(x)})

    return left.groupBy(group, "block").cogroup(right.groupBy(group, "block")).applyInArrow(meet, f"seed {id_kind}, vec_id {id_kind}, depth int, value double")


def two_hops(vectors: DataFrame, threshold: float, k: int, group: str = "label") -> DataFrame:
    """seed, vec_id, depth, score, rank: the k best rows within two hops of each row that is ``asked``.

    vectors: group, vec_id (unique), embedding, weight (0 or more), asked.  A hop
    leads to the rows of the group whose product reaches the threshold; a row's
    score is its best product with a row of the hop before, times its weight.
    Null groups and ids take no part.  A group's vectors, and the seeds' list, must
    fit one task; no pair does, and none is written but those of the lists.
    """
    rows = vectors.select(group, "vec_id", "embedding", F.col("weight").cast("double").alias("weight"), "asked").where(f"`{group}` is not null and vec_id is not null and size(embedding) > 0")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    done = None
    for turn in range(len(EDGES)):
        wanted = _kept(rows.where("asked").select(group).distinct().join(sizes, group))  # lists of groups that have seeds yet
        some = rows.join(wanted.select(group), group, "left_semi")
        bounds = _kept(_bounds(blocks.dealt(some, group, "weight"), wanted, group, threshold, turn))
        lists = _kept(_lists(blocks.dealt(some.join(bounds, group), group, "weight", "least"), group, threshold))
        found = _kept(_answers(some.join(bounds, group), lists, group, threshold, k, turn == len(EDGES) - 1))
        sure = found.where("vec_id is not null")
        done = sure if done is None else done.unionByName(sure)
        left = found.where("vec_id is null").select(F.col("seed").alias("vec_id"))
        if left.isEmpty():
            break
        rows = rows.drop("asked").join(left.withColumn("asked", F.lit(True)), "vec_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    w = Window.partitionBy("seed").orderBy(F.desc("score"), "vec_id")
    scored = done.withColumn("score", decay.final(F.col("value"))).withColumn("rank", F.row_number().over(w))
    return scored.select("seed", "vec_id", "depth", "score", "rank")
