"""MinHash near-duplicates: bottom-k sketches from one hash function, and exact confirmation.

A text's set holds the distinct hashes of its runs of five words.  Texts with the
same set are one class; the work below is on classes.

* A sketch is the 64 least hashes of a set.  Retained values that occur in one
  class only can't join classes, so the inverted lists leave them out.
* Two sets at the threshold share at least 3/4 of the larger one's sketch, give
  or take sampling.  A class therefore goes into the lists of its rarest values
  only, so many that the rest is, by five standard deviations, too small to hold
  all shared values (for sets that the sketch holds whole: exactly too small).
  This keeps passages that many texts share out of the lists.
* The union sketch estimates a pair's similarity; five standard deviations below
  the threshold it goes.  The full sets of the others are intersected.
* A list of up to ``SMALL`` classes gives all its pairs.  A longer one gives
  pairs with one pivot a round, the same for lists of the same classes at first,
  another for each list later; a pivot of many pairs is salted.  After ``ROUNDS``
  rounds the lists that still cross components are settled whole, in blocks of two
  chunks of classes.  First the sketches of a block are intersected as a matrix
  product, which tells the classes that may have a link into another component,
  each pair in the first list that it shares; then the full sets of these.  At
  most one edge a class comes out.  No link between components is missed, and no
  list gives all its pairs.  Chunks are bounded by classes (``CHUNK``) and by
  hashes (``LOAD``).

Defined cases: null and empty texts and texts without words have an empty set and
link with nothing; texts under five words have one shingle, the whole sequence;
rows with the same doc_id are separate documents that share an id; a null doc_id
takes part but never gives its component an id; an empty table gives an empty one;
other columns are left out of the links and stay in ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.llm import _shared
from lodestore.llm.components import components

SHINGLE = 5
KEPT = 64
SMALL = 8
ROUNDS = 2
CHUNK, LOAD = 1024, 1 << 19
SIGMAS = 5
#: Pairs that share a salt of their pivot.
SALTED = 1024
#: A filter of rows has so many bits as a power of two, at least and at most.
FEW_BITS, MOST_BITS = 20, 26


def shingles(text: str | None, hashes: _shared.WordHashes) -> np.ndarray:
    """The sorted distinct 63-bit hashes of a text's word shingles."""
    found = _shared.byte_words(text)
    if not found:
        return np.empty(0, np.int64)
    w = hashes.of(found)
    times = np.uint64(0x9E3779B97F4A7C15)
    if len(w) < SHINGLE:
        h = np.array([len(w)], dtype=np.uint64)
        for x in w:
            h = h * times + x
    else:
        n = len(w) - SHINGLE + 1
        h = w[:n].copy()
        for i in range(1, SHINGLE):
            h = h * times + w[i : i + n]
    return np.unique(_shared.mix(h) >> np.uint64(1)).view(np.int64)


def fingerprint(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def lists_type(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n, fp (null for an empty set) and the sketch of every row."""

    def run(batches):
        hashes = _shared.WordHashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), lists_type([s[:KEPT] for s in sets])],
                ["doc_id", "mark", "n", "fp", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _mark().alias("mark")).mapInArrow(_shared.released(run), f"doc_id {kind}, mark long, n long, fp binary, sketch array<long>")


def _mark():
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's retained values must be listed; those beyond can't hold all that a partner shares."""
    kept = min(n, KEPT)
    if n * 100 <= percent * KEPT:  # partners' sketches hold their whole sets, too
        return kept - math.ceil(kept * percent / 100) + 1
    p = percent / 100
    shared = math.floor(p * kept - SIGMAS * math.sqrt(kept * p * (1 - p)))
    return kept - max(1, shared) + 1


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """v, fp, n: the listed values of each class."""
    values = classes.select("fp", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(common, "v")
    lengths = F.create_map(*[x for n in range(1, KEPT + 1) for x in (F.lit(n), F.lit(prefix_length(n, percent)))])
    kept = F.least(F.col("n"), F.lit(KEPT)).cast("int")
    exact = F.col("n") * 100 <= percent * KEPT
    prefix = F.when(exact, F.element_at(lengths, kept)).otherwise(
        F.when(F.col("n") < KEPT, F.element_at(lengths, kept)).otherwise(F.lit(prefix_length(10 * KEPT, percent)))
    )
    by_class = Window.partitionBy("fp")
    ranked = shared.withColumn("rank", F.row_number().over(by_class.orderBy("df", "v"))).withColumn("m", F.count(F.lit(1)).over(by_class))
    # values of one class only are the rarest and take the first places
    return ranked.where(F.col("rank") <= prefix - (kept - F.col("m"))).select("v", "fp", "n")


class Filter:
    """Bits at the hashes of some rows, broadcast: tells most of the other rows apart; a full one tells none."""

    def __init__(self, rows: DataFrame, *columns: str):
        spark = rows.sparkSession
        self.power = min(MOST_BITS, max(FEW_BITS, (16 * rows.count()).bit_length()))
        words = (
            rows.select(self.bit(*columns).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toPandas()
        )  # 2 ** (MOST_BITS - 5) rows at most
        table = np.zeros(1 << (self.power - 5), dtype=np.uint32)
        table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
        self.table = spark.sparkContext.broadcast(table)

    def bit(self, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(1 << self.power))

    @staticmethod
    def hits(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)

    def may_hold(self, *columns: str):
        """False for rows that are certainly not among the filter's."""
        shared, hits = self.table, Filter.hits

        @F.pandas_udf("boolean")
        def test(bits: pd.Series) -> pd.Series:
            return pd.Series(hits(shared.value, bits.to_numpy()))

        return test(self.bit(*columns))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and the full set (array of long) of every class in ``wanted`` (rep, fp)."""
    found = Filter(wanted, "rep")
    shared, hits = found.table, Filter.hits

    def run(batches):
        hashes = _shared.WordHashes()
        for b in batches:
            at = b.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(hits(shared.value, at))
            for i in range(0, len(hit), 200):
                part = [shingles(t, hashes) for t in b.column(0).take(pa.array(hit[i : i + 200])).to_pylist()]
                part = [s for s in part if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in part], pa.binary()), lists_type(part)], ["fp", "whole"])

    sets = docs.select("text", found.bit("doc_id").alias("bit")).mapInArrow(_shared.released(run), "fp binary, whole array<long>")
    return sets.join(wanted.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b whose sizes allow the threshold; salts deal the pairs of a pivot out."""
    swap = F.col("a") > F.col("b")
    turned = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"), ("salt_a", "salt_b"), ("salt_b", "salt_a"))]
    near = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select(*turned)
    return near.groupBy("a", "b", "na", "nb").agg(F.max("salt_a").alias("salt_a"), F.max("salt_b").alias("salt_b"))


def _with_components(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("comp", F.col("fp"))
    return lists.join(roots, lists.fp == roots.node, "left").withColumn("comp", F.coalesce("root", "fp")).drop("node", "root")


def candidates(lists: DataFrame, roots: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of classes in different components: all of short lists, those with a pivot of long ones."""
    rows = _with_components(lists, roots)
    order = F.xxhash64("fp", "v", F.lit(turn)) if turn else F.xxhash64("fp")
    pivot = F.min(F.struct(order.alias("k"), "fp", "comp", "n")).alias("p")
    open_lists = rows.groupBy("v").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot).where("lo <> hi").drop("lo", "hi")
    joined = rows.join(open_lists, "v")
    near = joined.where(F.col("g") <= SMALL)
    left = near.select("v", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = near.select("v", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = left.join(right, "v").where("a < b and ca <> cb").select("a", "b", "na", "nb", F.lit(0).alias("salt_a"), F.lit(0).alias("salt_b"))
    star = joined.where((F.col("g") > SMALL) & (F.col("p.comp") != F.col("comp"))).select(
        F.col("p.fp").alias("a"), F.col("fp").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"),
        F.pmod(F.xxhash64("fp"), F.ceil(F.col("g") / SALTED)).cast("int").alias("salt_a"), F.lit(0).alias("salt_b"),
    )
    return _sized(pairs.unionByName(star), percent)


def _blocks(rows: DataFrame, values: DataFrame) -> DataFrame:
    """The rows (v, fp, n, comp) of lists that cross components, in blocks (v, i, j) of two chunks, with their ``values`` by fp."""
    crossing = rows.groupBy("v").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("load"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    chunks = F.greatest(F.ceil(F.col("g") / CHUNK), F.ceil(F.col("load") / LOAD)).cast("int")
    placed = (
        rows.join(crossing.select("v", chunks.alias("c")), "v").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, c - 1)")))
        .select("v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "n", "comp")
    )
    return placed.join(values, "fp").repartition(*BLOCK).sortWithinPartitions(*BLOCK)


BLOCK = ["v", "i", "j"]


def _each_block(batches, *columns: str):
    """(first row, the rows' arrays for each column, numbers of their components, table) of every block."""
    for table in _shared.whole_groups(batches, BLOCK):
        keys = [table.column(c).to_numpy() for c in BLOCK]
        new = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        comp = table.column("comp").to_pandas().factorize()[0]
        parts = []
        for c in columns:
            lists = table.column(c).combine_chunks()
            parts.append((lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield s, *([flat[ends[k] : ends[k + 1]] for k in range(s, e)] for flat, ends in parts), comp[s:e], table


def remaining(lists: DataFrame, roots: DataFrame | None, sketches: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that join the components which the lists that still cross components hold, a table to discard after)."""

    def screen(batches):
        for s, found, listed, comp, table in _each_block(batches, "sketch", "listed"):
            part = table.slice(s, len(found)).select(["v", "fp", "n", "comp"])
            v = part.column("v")[0].as_py()
            may = _may_link(found, part.column("n").to_numpy(), comp, percent, [x[x < v] for x in listed])
            yield from part.take(pa.array(np.flatnonzero(may))).to_batches()

    def settle(batches):
        for s, found, comp, table in _each_block(batches, "whole"):
            fps = table.column("fp").slice(s, len(found)).to_pylist()
            out = [(fps[x], fps[y]) for x, y in _links_in_list(found, comp, percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    rows = _with_components(lists, roots).select("v", "fp", "n", "comp")
    own = lists.groupBy("fp").agg(F.array_sort(F.collect_set("v")).alias("listed"))  # KEPT values at most
    screened = _shared.written(_blocks(rows, sketches.join(own, "fp")).mapInArrow(_shared.released(screen), "v long, fp binary, n long, comp binary").distinct())
    return _blocks(screened, sets).mapInArrow(_shared.released(settle), "a binary, b binary").distinct(), screened


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    size = len(sets)
    own = np.repeat(np.arange(size), [len(s) for s in sets])
    both = np.zeros((size, size), dtype=np.float32)
    if not len(own):
        return both
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # values of one class only meet nothing
    shared = times[at] > 1
    own, at = own[shared], column[at[shared]]
    width = int(column[-1]) + 1 if len(column) else 0
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    for low in range(0, width, 1024):
        s = slice(*np.searchsorted(at, [low, low + 1024]))
        block = np.zeros((size, min(1024, width - low)), dtype=np.float32)
        block[own[s], at[s] - low] = 1
        both += block @ block.T
    return both


def _may_link(sketches: list[np.ndarray], n: np.ndarray, comp: np.ndarray, percent: int, earlier: list[np.ndarray] | None = None) -> np.ndarray:
    """Whether the sketches leave it open that a set has a partner in another component.

    earlier: each set's lists before this one; pairs that share one are judged there.
    """
    size, p = len(sketches), percent / 100
    may = np.zeros(size, dtype=bool)
    if size < 2 or (comp == comp[0]).all():
        return may
    both = _intersections(sketches)
    if earlier is not None:
        both[_intersections(earlier) > 0] = 0
    kept = np.array([len(s) for s in sketches])
    most = np.iinfo(np.int64).max
    padded = np.full((size, KEPT), most)
    padded[np.repeat(np.arange(size), kept), np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)] = np.concatenate(sketches)
    tops = np.where(n > KEPT, padded[np.arange(size), kept - 1], most - 1)
    slack = lambda u: SIGMAS * np.sqrt(u * p * (1 - p))
    few = np.maximum(p * kept - slack(kept), 0.5)  # the union sketch holds all of the smaller sketch
    for low in range(0, size, 128):
        some = slice(low, low + 128)
        x, y = np.nonzero((both[some] >= np.minimum(few[some, None], few[None, :]) - 1e-6) & (comp[some, None] != comp[None, :]))
        x += low
        for at in range(0, len(x), 1 << 14):
            a, b = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            open_yet = ~(may[a] & may[b])
            a, b = a[open_yet], b[open_yet]
            top = np.minimum(tops[a], tops[b])[:, None]
            i = both[a, b]
            u = (padded[a] <= top).sum(axis=1) + (padded[b] <= top).sum(axis=1) - i
            exact = (n[a] <= KEPT) & (n[b] <= KEPT)
            fits = i >= u * p - np.where(exact, 0, slack(u)) - 1e-6
            may[a[fits]] = may[b[fits]] = True
    return may


def _links_in_list(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """At most one edge a class, which together join what links between components join."""
    size = len(sets)
    if size < 2 or (comp == comp[0]).all():
        return []
    n = np.array([len(s) for s in sets])
    both = _intersections(sets)
    first, second = [], []
    for low in range(0, size, 256):
        some = slice(low, low + 256)
        inter = both[some].astype(np.int64)
        x, y = np.nonzero((100 * inter >= percent * (n[some, None] + n[None, :] - inter)) & (comp[some, None] != comp[None, :]))
        first.append(x[x + low < y] + low)
        second.append(y[x + low < y])
    a, b = np.concatenate(first), np.concatenate(second)
    tops = np.arange(size)
    while len(a):
        before, least = tops.copy(), np.minimum(tops[a], tops[b])
        np.minimum.at(tops, a, least)
        np.minimum.at(tops, b, least)
        tops = tops[tops]
        if (tops == before).all():
            break
    return [(i, int(t)) for i, t in enumerate(tops.tolist()) if i != t]


def _beside(pairs: DataFrame, side: str, values: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the class's value at one side; of a pivot's value there is a copy for each salt."""
    salt = f"salt_{side}"
    copies = pairs.select(F.col(side).alias("fp"), salt).distinct().join(values, "fp")
    return pairs.join(copies.select(F.col("fp").alias(side), salt, F.col(column).alias(f"{column}_{side}")), [side, salt])


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch doesn't rule the threshold out."""
    bound = lambda s, n: f"if({n} > {KEPT}, element_at({s}, -1), {2**63 - 1})"
    p = percent / 100
    both = _beside(_beside(pairs, "a", sketches, "sketch"), "b", sketches, "sketch")
    return (
        both.withColumn("top", F.expr(f"least({bound('sketch_a', 'na')}, {bound('sketch_b', 'nb')})"))
        .withColumn("u", F.expr("size(filter(array_union(sketch_a, sketch_b), x -> x <= top))"))
        .withColumn("i", F.expr("size(filter(array_intersect(sketch_a, sketch_b), x -> x <= top))"))
        .where(F.expr(f"i >= u * {p}D - if(na <= {KEPT} and nb <= {KEPT}, 0D, {SIGMAS} * sqrt(u * {p * (1 - p)}D)) - 1e-9D"))
        .select(*pairs.columns)
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = _beside(_beside(pairs, "a", sets, "whole"), "b", sets, "whole").withColumn("i", F.size(F.array_intersect("whole_a", "whole_b")))
    return both.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, mark, n, fp and ``group`` of every row: rows of one group are linked; null where a text has no words."""
    rows = _shared.written(signatures(docs))
    classes = _shared.written(
        rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    lists = _shared.written(inverted_lists(classes, percent))
    listed = _shared.written(classes.join(lists.groupBy("v").agg(F.count(F.lit(1)).alias("g")).where("g > 1").join(lists, "v").select("fp").distinct(), "fp", "left_semi"))
    sets = _shared.written(sets_of(docs, listed.select("rep", "fp")))
    sketches = listed.select("fp", "sketch")

    links = tested = roots = None
    made: list[DataFrame] = []
    for turn in range(ROUNDS):
        pairs = candidates(lists, roots, turn, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _shared.written(pairs)
        likely = _shared.written(plausible(pairs, sketches, percent))
        new = _shared.written(confirmed(likely, sets, percent))
        made += [pairs, likely, new]
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = components(links)
    found, screened = remaining(lists, roots, sketches, sets, percent)
    new = _shared.written(found)
    made.append(new)
    if not new.isEmpty():
        roots = components(new if links is None else links.unionByName(new))
    _shared.discard(classes, lists, listed, sets, screened, *made)
    found = rows.drop("sketch")
    if roots is None:
        return found.withColumn("group", F.col("fp"))
    joined = found.where("fp is not null").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    empty = found.where("fp is null").withColumn("group", F.lit(None).cast("binary"))
    return joined.select(*empty.columns).unionByName(empty)


def link_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    rows = _shared.written(grouped(docs, percent))
    first = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    together = rows.where("group is not null").join(first, "group", "left")
    named = together.unionByName(rows.where("group is null"), allowMissingColumns=True).withColumn("component_id", F.coalesce("first", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group stays, and every row without words.

    It is a row of the least doc_id (nulls last), of the least text hash among
    these; of rows that repeat both, any one.  Other rows of that doc_id that are
    not linked with it stay.
    """
    rows = _shared.written(grouped(docs, percent))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")).alias("least")
    several = rows.where("group is not null").groupBy("group").agg(least, F.count(F.lit(1)).alias("m")).where("m > 1")
    members = rows.where("group is not null").join(several, "group").select("doc_id", "mark", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark").alias("own"), "least")
    # rows by id and text: the groups' first ones and the others
    marked = _shared.written(members.groupBy("doc_id", "mark").agg(F.bool_or(F.col("own") == F.col("least")).alias("stays"), F.count(F.lit(1)).alias("times")))
    keyed = docs.withColumn(MARK, _mark())
    same = lambda d: (F.col(f"{d}.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col(f"{d}.mark") == F.col(f"r.`{MARK}`"))
    # texts move only where the filter can't tell that their rows stay
    judged = marked.where("not stays or times > 1")
    test = Filter(judged, "doc_id", "mark").may_hold("doc_id", MARK)
    kept = keyed.where(~test).unionByName(keyed.where(test).alias("r").join(judged.alias("x"), same("x"), "left_anti"))
    again = marked.where("stays and times > 1")
    if not again.isEmpty():
        kept = kept.unionByName(keyed.where(test).alias("r").join(again.alias("y"), same("y"), "left_semi").dropDuplicates(["doc_id", MARK]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


MARK = "near_dup: hash of the text"


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
