"""LM scoring: a hierarchical Pitman-Yor trigram model, seated by Gibbs sampling.

Tokens are a text's words and one end.  A word's restaurant is that of the two
tokens before it (ends at the start of a text); its parent is the restaurant of
the one token before it, which all longer contexts with that token share; the
parent of all of these is one root restaurant of the whole corpus, and the root's
parent is the uniform distribution over the known types and one unknown.

Seating is blocked Gibbs sampling, from the longest contexts to the root.  Given
the parent's distribution, the restaurants below it are independent, and given an
auxiliary gamma variable of its own, so are a restaurant's dishes: with
``x ~ Gamma(strength / d + tables)`` the tables of a dish of c customers follow
``S_d(c, t) * (d * x * P(dish)) ** t``, where S are generalised Stirling numbers
(exactly up to ``EXACT`` customers; above, customers are seated by blocks).  Each
table sends one customer to the parent, and the parent's distribution is drawn
from its posterior by gamma variables, the part that it has yet to draw from its
own parent taken at the mean.  The predictive probabilities of ``SAMPLES`` sweeps
after ``BURN`` are averaged.

Classes: a one-token context and all longer ones that end in it go to one of the
classes of about ``CLASS_TOKENS`` training tokens.  A token that occurs in more
than half as many is split by the token before it, and a pair of tokens that does
by the text's number; every piece is a restaurant of its own below the root and
holds about half a class, so no class grows with the corpus.  In each of the
``EXCHANGES`` the classes send their tables, by word, to shards of the root, which
seat the root and answer with its distribution and the words' corpus counts.

Passes: one counts words and the frequent pairs.  One makes each run of texts'
trigrams into packed arrays, one for each class, and the run's own row; these are
dealt once and read again by every exchange.  Row numbers are given there and
nowhere else.  The last exchange answers each run with one packed array a class,
and a run's answers are summed by text.

The base score takes the counts of the ``2 ** HEAD`` most frequent words from a
broadcast table and those of the others from the root.

Defined cases: a null or empty text is the end alone; a null doc_id counts as the
empty text for the fold; repeated rows are counted and scored one by one; without
training rows every token is unknown; an empty table gives an empty one; other
columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared

CLASS_TOKENS = 1 << 20
HEAD, HOT_PAIRS = 18, 17
EXACT = 256
EXCHANGES, BURN, SAMPLES = 1, 2, 4
LONG_STRENGTH, SHORT_STRENGTH, ROOT_STRENGTH = 0.5, 2.0, 10.0
#: Classes whose words a shard of the root holds, in number; sweeps of a shard over its own words.
SHARD_CLASSES, ROOT_SWEEPS = 8, 3
#: Tokens and texts of a run, the words that a task remembers, and the tokens that are looked up together.
RUN_TOKENS, RUN_TEXTS, REMEMBERED, TOGETHER = 1 << 20, 1 << 16, 300_000, 1 << 14
#: Occurrences in a run from which a pair is counted.
OFTEN = 16
END = b""
HELD_OUT = 1
TAIL = np.uint64(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- packed arrays

_CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes; whole ones in the least width that holds them."""
    head, parts = [], []
    for a in arrays:
        if a.dtype.kind == "f":
            kind, width = a.dtype.itemsize << 4, a.dtype.itemsize
        else:
            most = int(a.max()) if len(a) else 0
            width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
            kind = width
            a = a.astype(f"<u{width}")
        head += [kind, len(a)]
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T).tobytes())
    body = b"".join([np.array([len(arrays), *head], dtype="<u4").tobytes(), *parts])
    return len(body).to_bytes(8, "little") + pa.Codec(_CODEC, 1).compress(body, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    body = pa.Codec(_CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    count = int.from_bytes(body[:4], "little")
    head = np.frombuffer(body, "<u4", 2 * count, 4).tolist()
    at, out = 4 + 8 * count, []
    for kind, n in zip(head[::2], head[1::2], strict=True):
        width = kind >> 4 or kind
        planes = np.frombuffer(body, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<{'f' if kind >> 4 else 'u'}{width}").reshape(-1))
        at += width * n
    return out


# ---------------------------------------------------------------- the model


def stirling(most: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of customers and tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, t] = out[c, t] + np.log(c - d * t)
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def by_size(c: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(customers, dishes with so many) from two customers on; those beyond ``EXACT`` are together at the end."""
    at = np.flatnonzero(c >= 2)
    sizes = np.minimum(c[at], EXACT + 1).astype(np.uint16)
    at = at[np.argsort(sizes, kind="stable")]
    edges = np.cumsum(np.bincount(sizes, minlength=EXACT + 2)).tolist()
    return [(n, at[edges[n - 1] : edges[n]]) for n in range(2, EXACT + 2) if edges[n] > edges[n - 1]]


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, table: np.ndarray, random, sizes: list | None = None) -> np.ndarray:
    """Tables of dishes with c customers: t with probability in proportion to ``S_d(c, t) * a ** t``."""
    out = np.minimum(c, 1)
    for n, dishes in by_size(c) if sizes is None else sizes:
        if n == 2:
            out[dishes] = 1 + (random.random(len(dishes)) * (1 - d + a[dishes]) < a[dishes])
        elif n <= EXACT:
            step = (1 << 19) // n
            for low in range(0, len(dishes), step):
                at = dishes[low : low + step]
                logits = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(np.maximum(a[at], 1e-250))[:, None]
                edge = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
                out[at] = 1 + (random.random(len(at))[:, None] * edge[:, -1:] > edge).sum(axis=1)
        else:  # by blocks of customers, each against the tables before it
            most, now, seated, new = c[dishes], np.ones(len(dishes)), np.ones(len(dishes)), a[dishes]
            while (seated < most).any():
                then = np.minimum(most, np.maximum(seated + 1, np.floor(seated * 1.5)))
                mean = new * np.log((then + new - d * now) / np.maximum(seated + new - d * now, 1e-9))
                now = np.minimum(now + np.minimum(random.poisson(np.maximum(mean, 0)), then - seated), then)
                seated = then
            out[dishes] = now.astype(out.dtype)
    return out


def discount(once: float, twice: float) -> float:
    """The discount for so many dishes with one and with two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _few(counts: np.ndarray) -> tuple[int, int]:
    return int((counts == 1).sum()), int((counts == 2).sum())


class Seating:
    """The restaurants of a class.

    For each distinct trigram, sorted: ``long`` and ``short``, the numbers of its two
    contexts, ``word`` and ``count`` of training customers; trigrams of one short
    context and word stand together.  A pair is such a context and word.
    """

    def __init__(self, long: np.ndarray, short: np.ndarray, word: np.ndarray, count: np.ndarray, words: int):
        new = np.ones(len(word), dtype=bool)
        new[1:] = (short[1:] != short[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        self.words, self.word, self.place = words, word[first], short[first]
        self.places, self.pairs = int(short.max()) + 1, len(first)
        self.pair, self.long, self.count = np.cumsum(new) - 1, long, count
        self.d = discount(*_few(count))
        self.table = stirling(EXACT, self.d)
        self.total = np.bincount(long, weights=count)
        # only trigrams of several customers have a choice; the others have one table each
        self.several = np.flatnonzero(count >= 2)
        self.sizes = by_size(count[self.several])
        self.single_tables = np.bincount(long, weights=count == 1, minlength=len(self.total))
        self.contexts, self.context = np.unique(long[self.several], return_inverse=True)
        self.single_customers = np.bincount(self.pair, weights=count == 1, minlength=self.pairs)
        # the pairs whose probability the several need, and the others by place
        self.needed, self.need = np.unique(self.pair[self.several], return_inverse=True)
        self.t = np.ones(len(self.several), dtype=np.int64)
        self._customers()
        self.short_d = discount(*_few(self.c))
        self.short_table = stirling(EXACT, self.short_d)
        self.short_t = np.minimum(self.c, 1)

    def _customers(self) -> None:
        """The tables of the longer contexts are the customers of the shared ones."""
        c = self.single_customers.copy()
        c[self.needed] += np.bincount(self.need, weights=self.t, minlength=len(self.needed))
        self.c = c.astype(np.int64)
        self.short_total = np.bincount(self.place, weights=c, minlength=self.places)

    def _short_tables(self) -> np.ndarray:
        return np.bincount(self.place, weights=self.short_t, minlength=self.places)

    def seat_short(self, root: np.ndarray, random) -> None:
        x = random.standard_gamma(SHORT_STRENGTH / self.short_d + self._short_tables())
        self.short_t = draw_tables(self.c, self.short_d * x[self.place] * root[self.word], self.short_d, self.short_table, random)

    def seat_long(self, root: np.ndarray, random) -> None:
        """Draws the shared restaurants' distributions where they are needed, and the tables of the longer contexts."""
        if not len(self.several):
            return
        shape = np.maximum(self.c - self.short_d * self.short_t, 0.0)
        at = self.place[self.needed]
        own = random.standard_gamma(shape[self.needed])
        others = shape.copy()
        others[self.needed] = 0.0
        rest = random.standard_gamma(SHORT_STRENGTH + self.short_d * self._short_tables())
        mass = np.bincount(at, weights=own, minlength=self.places) + random.standard_gamma(np.bincount(self.place, weights=others, minlength=self.places)) + rest
        p = (own + rest[at] * root[self.word[self.needed]]) / mass[at]
        tables = self.single_tables[self.contexts] + np.bincount(self.context, weights=self.t, minlength=len(self.contexts))
        x = random.standard_gamma(LONG_STRENGTH / self.d + tables)
        self.t = draw_tables(self.count[self.several], self.d * x[self.context] * p[self.need], self.d, self.table, random, self.sizes)
        self._customers()

    def sweep(self, root: np.ndarray, random) -> None:
        """Seats everybody anew; root: the root's probability of each word."""
        self.seat_long(root, random)
        self.short_t = np.minimum(self.short_t, self.c)  # a dish that has lost customers has no more tables than are left
        self.seat_short(root, random)

    def predictive(self, root: np.ndarray) -> np.ndarray:
        """The probability of each trigram given the seating."""
        rest = SHORT_STRENGTH + self.short_d * self._short_tables()
        p = (self.c - self.short_d * self.short_t + rest[self.place] * root[self.word]) / (SHORT_STRENGTH + self.short_total)[self.place]
        tables, own = self.single_tables.copy(), self.count - self.d * (self.count == 1)
        tables[self.contexts] += np.bincount(self.context, weights=self.t, minlength=len(self.contexts))
        own[self.several] -= self.d * self.t
        return (own + (LONG_STRENGTH + self.d * tables)[self.long] * p[self.pair]) / (LONG_STRENGTH + self.total)[self.long]

    def sampled(self, root: np.ndarray, random) -> np.ndarray:
        """Averaged predictive probability of each trigram."""
        self.seat_short(root, random)
        for _ in range(BURN):
            self.sweep(root, random)
        out = np.zeros(len(self.count))
        for _ in range(SAMPLES):
            self.sweep(root, random)
            out += self.predictive(root)
        return out / SAMPLES

    def sent(self) -> np.ndarray:
        """The tables of each word that go up to the root."""
        return np.bincount(self.word, weights=self.short_t, minlength=self.words).astype(np.int64)

    def resume(self, t: np.ndarray, short_t: np.ndarray) -> None:
        self.t, self.short_t = t.astype(np.int64), short_t.astype(np.int64)
        self._customers()

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        return self.t, self.short_t


# ---------------------------------------------------------------- texts


class Words:
    """Numbers of the words that a task has met, and their hashes."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.listed: list[int] = []

    def of(self, found: list[bytes]) -> np.ndarray:
        new = set(found).difference(self.numbers)
        self.numbers.update(zip(new, range(len(self.listed), len(self.listed) + len(new)), strict=True))
        self.listed += map(xxhash.xxh3_64_intdigest, new)
        return np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found))

    def hashes(self) -> np.ndarray:
        return np.array(self.listed, dtype=np.uint64)


class Run:
    """The tokens of some texts: their numbers in ``words``, the ends included, and the texts' sizes."""

    def __init__(self, tokens: np.ndarray, sizes: list[int]):
        self.tokens, self.sizes = tokens, np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def before(self, tokens: np.ndarray, end: int) -> np.ndarray:
        """Each token's predecessor; the end before a text's first."""
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[self.starts] = end
        return out


def runs(batches, words: Words):
    """(Run, the other columns of its texts) for all texts, in order."""
    parts, found, size, sizes, columns = [], [], 0, [], []
    for b in batches:
        first = 0
        for i, text in enumerate(b.column(0).to_pylist()):
            listed = _shared.byte_words(text)
            listed.append(END)
            sizes.append(len(listed))
            size += len(listed)
            found += listed
            if len(found) >= TOGETHER:
                parts.append(words.of(found))
                found = []
            if size >= RUN_TOKENS or len(sizes) >= RUN_TEXTS:
                columns.append(b.slice(first, i + 1 - first))
                yield Run(np.concatenate([*parts, words.of(found)]), sizes), pa.Table.from_batches(columns)
                parts, found, size, sizes, columns, first = [], [], 0, [], [], i + 1
                if len(words.numbers) > REMEMBERED:
                    words.forget()
        if first < b.num_rows:
            columns.append(b.slice(first))
    if sizes:
        yield Run(np.concatenate([*parts, words.of(found)]), sizes), pa.Table.from_batches(columns)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _shared.mix(first * _A + second)


def count_words(docs: DataFrame) -> DataFrame:
    """w (hash as long), pair, n: the tokens of the training rows, and their pairs that are frequent in a run."""

    def run(batches):
        words, total = Words(), np.empty(0, dtype=np.int64)
        for r, _ in runs(batches, words):
            hashes = words.hashes()
            n = np.bincount(r.tokens, minlength=len(hashes))
            n[: len(total)] += total
            total = n
            both = np.sort(r.before(r.tokens, words.numbers[END]).astype(np.int64) << 32 | r.tokens)
            start = np.flatnonzero(np.diff(both, prepend=-1))
            times = np.diff(np.append(start, len(both)))
            often = both[start[times >= OFTEN]]
            yield _counted(_pair(hashes[often >> 32], hashes[often & 0xFFFFFFFF]), times[times >= OFTEN], True)
            if len(words.numbers) > REMEMBERED:  # they are forgotten before the next run
                yield _counted(hashes, total, False)
                total = np.empty(0, dtype=np.int64)
        if len(total):
            yield _counted(hashes, total, False)

    training = docs.where(_shared.fold() != HELD_OUT).select("text")
    return training.mapInArrow(_shared.released(run), "w long, pair boolean, n long").groupBy("w", "pair").agg(F.sum("n").alias("n"))


def _counted(hashes: np.ndarray, n: np.ndarray, pair: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(n), pair)), pa.array(n.astype(np.int64))], ["w", "pair", "n"])


class Table:
    """Numbers by hash, 0 for hashes that it lacks."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where each is, -1 for those it lacks."""
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self.places(wanted)
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)


def _table(rows: DataFrame) -> Table:
    found = rows.select("w", "n").toPandas()
    return Table(found["w"].to_numpy(dtype=np.int64).view(np.uint64), found["n"].to_numpy(dtype=np.int64))


PLACED = "key int, run long, ids array<{}>, data binary"


def placed_runs(docs: DataFrame, shared, classes: int) -> DataFrame:
    """For each run its own row (a key below 0: ids of the texts, sizes, base sums) and a row for each class (a key from 0)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        head, hot = shared.value
        words, number = Words(), TaskContext.get().partitionId() << 32
        for r, columns in runs(batches, words):
            number += 1
            yield from _rows(r, columns, words, head, hot, classes, number)

    prepared = docs.select("text", "doc_id", (_shared.fold() == HELD_OUT).alias("held_out"))
    return prepared.mapInArrow(_shared.released(run), PLACED.format(kind))


def _rows(r: Run, columns: pa.Table, words: Words, head: Table, hot: Table, classes: int, number: int):
    """The run's own row, then a batch of its classes' rows."""
    n, m = len(r.tokens), len(r.sizes)
    hashes = words.hashes()
    met = np.flatnonzero(np.bincount(r.tokens, minlength=len(hashes)))
    renamed = np.zeros(len(hashes), dtype=np.int64)
    hashes = hashes[met]
    at = head.places(hashes)
    codes = np.where(at >= 0, at.astype(np.uint64), hashes | TAIL)
    order = np.argsort(codes)  # words are renamed by their codes' order
    met, hashes, at, codes = met[order], hashes[order], at[order], codes[order]
    count = np.where(at >= 0, head.counts[at] if len(head.counts) else 0, 0)
    renamed[met] = np.arange(len(met))
    w = renamed[r.tokens]
    end = int(renamed[words.numbers[END]])
    v = r.before(w, end)
    u = r.before(v, end)
    owner = np.repeat(np.arange(m), r.sizes)
    known = at >= 0
    base = np.bincount(owner, weights=np.where(known, np.log10(count + 0.5), 0.0)[w], minlength=m)
    n_known = np.bincount(owner, weights=known[w], minlength=m).astype(np.int64)
    held = columns.column(2).to_numpy().astype(np.uint8)
    ids = columns.column(1).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    own = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([pa.array([-1 - int(_shared.mix(np.array([number], dtype=np.uint64))[0] % np.uint64(classes))], pa.int32()), pa.array([number], pa.int64()), own, pa.array([pack(r.sizes, n_known, held, base)], pa.binary())], NAMES)

    # the restaurant of the token before: by its word, where that is too frequent also by the word before it
    of_word = _shared.mix(hashes)
    place = of_word[v]
    pieces = 1 + 2 * count // CLASS_TOKENS
    split = np.flatnonzero(pieces[v] > 1)
    if len(split):
        piece = of_word[u[split]] % pieces[v[split]].astype(np.uint64)
        both = _pair(hashes[u[split]], hashes[v[split]])
        times = hot.of(both)
        often = np.flatnonzero(times)
        copies = (1 + 2 * times[often] // CLASS_TOKENS).astype(np.uint64)
        texts = _shared.mix((owner[split[often]].astype(np.uint64) + np.uint64(1)) * _A + np.uint64(number))
        piece[often] = both[often] + texts % copies
        place[split] = _shared.mix(place[split] + (piece + np.uint64(1)) * _B)
    where = (place % np.uint64(classes)).astype(np.int64)
    # places in the order of their classes
    distinct, place_of = np.unique(place, return_inverse=True) if len(split) else (None, None)
    if distinct is None:
        class_of = (of_word % np.uint64(classes)).astype(np.int64)
        rank = np.empty(len(met), dtype=np.int64)
        rank[np.argsort(class_of, kind="stable")] = np.arange(len(met))
        slot = rank[v]
    else:
        class_of = (distinct % np.uint64(classes)).astype(np.int64)
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.argsort(class_of, kind="stable")] = np.arange(len(distinct))
        slot = rank[place_of]
    if len(met) < 1 << 21 and int(slot.max()) < 1 << 21:
        order = np.argsort(slot << 42 | w << 21 | u)
    else:
        order = np.lexsort((u, w, slot))
    slot, w, u, v, place, where = slot[order], w[order], u[order], v[order], place[order], where[order]
    text = owner[order] << 1 | held[owner[order]]
    new = np.ones(n, dtype=bool)
    new[1:] = slot[1:] != slot[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    spread = np.where(pieces[v[first]] > 1, place[first], np.uint64(0))  # others follow from the word
    bounds = np.searchsorted(where, np.arange(classes + 1)).tolist()
    groups = np.searchsorted(first, bounds).tolist()
    seen = np.zeros(len(met), dtype=bool)
    local = np.zeros(len(met), dtype=np.int64)
    keys, rows = [], []
    for k in range(classes):
        a, b, g, h = bounds[k], bounds[k + 1], groups[k], groups[k + 1]
        if a == b:
            continue
        mine = (w[a:b], u[a:b], v[first[g:h]])
        if (b - a) * 4 > len(met):
            for x in mine:
                seen[x] = True
            used = np.flatnonzero(seen)
            seen[used] = False
        else:
            used = np.unique(np.concatenate(mine))
        local[used] = np.arange(len(used))
        code = codes[used]
        frequent = int(np.searchsorted(code, TAIL))
        ws = local[mine[0]]
        keys.append(k)
        rows.append(pack(np.diff(code[:frequent], prepend=np.uint64(0)), code[frequent:], local[mine[2]], spread[g:h], sizes[g:h], _steps(ws, len(used)), local[mine[1]], text[a:b]))
        if len(rows) >= 256:
            yield _class_rows(keys, number, rows, ids.type)
            keys, rows = [], []
    if rows:
        yield _class_rows(keys, number, rows, ids.type)


NAMES = ["key", "run", "ids", "data"]


def _class_rows(keys: list[int], number: int, rows: list[bytes], kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([number] * len(keys), pa.int64()), pa.nulls(len(keys), pa.list_(kind)), pa.array(rows, pa.binary())], NAMES)


def _mask(size: int) -> int:
    return 0xFFFF if size <= 1 << 16 else 0xFFFFFFFF


def _steps(values: np.ndarray, size: int) -> np.ndarray:
    """Differences of numbers below ``size``; those below 0 wrap."""
    return np.diff(values, prepend=0) & _mask(size)


def _summed(steps: np.ndarray, size: int) -> np.ndarray:
    return np.cumsum(steps.astype(np.int64)) & _mask(size)


class Trigrams:
    """The distinct trigrams of a class in a fixed order; with ``texts`` also the runs' tokens."""

    def __init__(self, found: pa.Table, texts: bool):
        runs_of, data = found.column("run").to_pylist(), found.column("data").to_pylist()
        parts, dictionaries = [], []
        for blob in data:
            steps, tail, v, spread, sizes, w, u, text = unpack(blob)
            code = np.concatenate([np.cumsum(steps, dtype=np.uint64), tail.astype(np.uint64)])
            dictionaries.append(code)
            parts.append((v, spread, sizes, _summed(w, len(code)), u, text))
        self.codes, at = np.unique(np.concatenate(dictionaries), return_inverse=True)
        size = len(self.codes)
        starts = np.cumsum([0, *map(len, dictionaries)]).tolist()
        names = [at[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        v, spread, sizes = (np.concatenate([x for x in column]) for column in ([n[p[0]] for n, p in zip(names, parts, strict=True)], [p[1].astype(np.uint64) for p in parts], [p[2].astype(np.int64) for p in parts]))
        w = np.concatenate([n[p[3]] for n, p in zip(names, parts, strict=True)])
        u = np.concatenate([n[p[4]] for n, p in zip(names, parts, strict=True)])
        text = np.concatenate([p[5].astype(np.int64) for p in parts])
        lengths = [len(p[5]) for p in parts]
        del parts, dictionaries, at, names
        # a piece's own number, or the word's; numbers of pieces are hashes, those of words are small
        place = np.where(spread > 0, spread, v.astype(np.uint64))
        places, short = np.unique(place, return_inverse=True)
        short = np.repeat(short, sizes)
        if size < 1 << 21 and len(places) < 1 << 21:
            key = short << 42 | w << 21 | u
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            del key
        else:
            order = np.lexsort((u, w, short))
            new = np.zeros(len(order), dtype=bool)
            new[0] = True
            for x in (short[order], w[order], u[order]):
                new[1:] |= x[1:] != x[:-1]
        one = order[new]
        trigram = np.empty(len(order), dtype=np.int32)
        trigram[order] = np.cumsum(new) - 1
        self.short, self.word = short[one], w[one]
        context = self.short * size + u[one]
        self.long = np.unique(context, return_inverse=True)[1]
        training = 1 - (text & 1)
        self.count = np.bincount(trigram, weights=training, minlength=len(one)).astype(np.int64)
        self.uses = np.bincount(w, weights=training, minlength=size).astype(np.int64)
        if texts:
            self.trigram, self.text, self.lengths, self.runs, self.token = trigram, text >> 1, lengths, runs_of, w

    def seating(self) -> Seating:
        return Seating(self.long, self.short, self.word, self.count, len(self.codes))


# ---------------------------------------------------------------- exchanges with the root

UP = "shard int, key int, data binary, state binary, totals array<double>"
DOWN = "key int, shard int, data binary, state binary, totals array<double>"


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (_shared.mix(codes * _A + _B) % np.uint64(shards)).astype(np.int64)


class FromRoot:
    """The root's answer to a class: probabilities and corpus counts of its words, and the class's own state."""

    def __init__(self, answers: pa.Table, codes: np.ndarray, types: int, shards: int, seed: list[int] | None):
        """seed None: the answers are means, else they are drawn and the rest is drawn here, alike in all classes."""
        rows = {r["shard"]: r for r in answers.to_pylist()}
        self.own, self.uses = np.zeros(len(codes)), np.zeros(len(codes), dtype=np.int64)
        order = np.argsort(_shard_of(codes, shards), kind="stable")
        cuts = np.searchsorted(_shard_of(codes, shards)[order], np.arange(shards + 1))
        state = b""
        for s in range(shards):
            self.own[order[cuts[s] : cuts[s + 1]]], self.uses[order[cuts[s] : cuts[s + 1]]] = unpack(rows[s]["data"])
            state = rows[s]["state"] or state
        self.state = unpack(state)
        # every shard answers every class, so each class knows the totals
        self.shares = np.array([rows[s]["totals"] for s in range(shards)])
        drawn, tables, once, twice = self.shares.sum(axis=0)
        rest = ROOT_STRENGTH + discount(once, twice) * tables
        if seed is not None:
            rest = np.random.default_rng(seed).standard_gamma(rest)
        self.p = (self.own + rest / (types + 1)) / (drawn + rest)


def seat_class(key: int, found: pa.Table, answers: pa.Table | None, types: int, shards: int, seed: list[int]) -> pa.Table:
    """Sweeps of a class, and its tables, a row for each shard of the root."""
    trigrams = Trigrams(found, False)
    seating, random = trigrams.seating(), np.random.default_rng([*seed, key])
    told = None
    if answers is None:
        root = np.full(len(trigrams.codes), 1.0 / (types + 1))
    else:
        told = FromRoot(answers, trigrams.codes, types, shards, seed)
        seating.resume(*told.state)
        root = told.p
    seating.seat_short(root, random)
    for _ in range(BURN):
        seating.sweep(root, random)
    sent = seating.sent()
    shard = _shard_of(trigrams.codes, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = []
    for s in range(shards):
        at = order[cuts[s] : cuts[s + 1]]
        before = [*told.shares.sum(axis=0).tolist(), told.shares[s, 1]] if told else None
        rows.append((s, key, pack(trigrams.codes[at], sent[at], trigrams.uses[at]), pack(*seating.state()) if s == key % shards else None, before))
    return _batch(rows, UP)


def seat_root(found: pa.Table, types: int, last: bool, seed: list[int]) -> pa.Table:
    """Seats a shard of the root from all classes' tables; a row for each class with its words' part of the distribution and corpus counts."""
    rows = found.to_pylist()
    shard = rows[0]["shard"]
    parts = [unpack(r["data"]) for r in rows]
    dishes, at = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(dishes)).astype(np.int64)
    uses = np.bincount(at, weights=np.concatenate([p[2] for p in parts]), minlength=len(dishes)).astype(np.int64)
    t = np.minimum(c, 1)
    before = rows[0]["totals"]  # the totals of the exchange before and this shard's tables; at first each type has one
    random = np.random.default_rng([*seed, shard])
    d = discount(before[2], before[3]) if before else discount(*_few(c))
    outside = max(0.0, before[1] - before[4] if before else float(types - t.sum()))
    stirlings = stirling(EXACT, d)
    for _ in range(ROOT_SWEEPS):
        x = random.standard_gamma(ROOT_STRENGTH / d + outside + t.sum())
        t = draw_tables(c, np.full(len(c), d * x / (types + 1)), d, stirlings, random)
    own = np.maximum(c - d * t, 0.0)
    if not last:
        own = random.standard_gamma(own)
    totals = [float(own.sum()), float(t.sum()), *map(float, _few(c))]
    out, begin = [], 0
    for r, p in zip(rows, parts, strict=True):
        here = at[begin : begin + len(p[0])]
        begin += len(p[0])
        out.append((r["key"], shard, pack(own[here].astype("<f4"), uses[here]), r["state"], totals))
    return _batch(out, DOWN)


def score_class(key: int, found: pa.Table, answers: pa.Table, types: int, shards: int, seed: list[int]) -> list[tuple[int, bytes]]:
    """(run, packed sums of the texts' tokens in this class) of every run."""
    trigrams = Trigrams(found, True)
    told = FromRoot(answers, trigrams.codes, types, shards, None)
    seating = trigrams.seating()
    seating.resume(*told.state)
    logs = np.log10(seating.sampled(told.p, np.random.default_rng([*seed, key])))
    rare = np.log10(told.uses + 0.5)
    tail = trigrams.codes >= TAIL
    out, begin = [], 0
    for run, n in zip(trigrams.runs, trigrams.lengths, strict=True):
        s = slice(begin, begin + n)
        begin += n
        texts, at = np.unique(trigrams.text[s], return_inverse=True)
        score = np.bincount(at, weights=logs[trigrams.trigram[s]])
        token = trigrams.token[s]
        few = np.flatnonzero(tail[token])
        others, place = np.unique(trigrams.text[s][few], return_inverse=True)
        base = np.bincount(place, weights=rare[token[few]], minlength=len(others))
        n_known = np.bincount(place, weights=told.uses[token[few]] > 0, minlength=len(others)).astype(np.int64)
        out.append((run, pack(texts, score.astype("<f4"), others, base, n_known)))
    return out


def summed(found: pa.Table, n: int, denominator: float) -> pa.Table:
    """The scored texts of a run, from its own row and its classes' answers."""
    ids = found.column("ids").combine_chunks()
    own = next(i for i, x in enumerate(found.column("key").to_pylist()) if x < 0)
    data = found.column("data").to_pylist()
    sizes, n_known, held, base = unpack(data[own])
    n_known, base = n_known.astype(np.int64), base.astype(np.float64)
    score = np.zeros(len(sizes))
    for i, blob in enumerate(data):
        if i != own:
            texts, sums, others, rare, known = unpack(blob)
            score[texts] += sums
            base[others] += rare
            n_known[others] += known.astype(np.int64)
    chunk = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return pa.table({
        "doc_id": chunk[own].values, "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(n_known),
        "train_tokens": pa.array(np.full(len(sizes), n, dtype=np.int64)), "base_score": pa.array(base - sizes * math.log10(denominator)), "score": pa.array(score),
    })


def score_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    _shared.batches_by_bytes(spark)
    docs = docs.select("doc_id", "text")
    counts = _shared.written(count_words(docs))
    words = counts.where("not pair")
    n, types, head_from = _totals(words)
    head = _table(words.where(F.col("n") >= head_from))  # 2 ** HEAD words at most
    hot = _table(counts.where("pair").where(F.col("n") >= max(CLASS_TOKENS // 2, -(-n >> HOT_PAIRS))))  # 2 ** HOT_PAIRS pairs at most
    shared = spark.sparkContext.broadcast((head, hot))
    classes = max(1, round(n / CLASS_TOKENS))
    shards = -(-classes // SHARD_CLASSES)
    denominator = n + 0.5 * (types + 1)

    key_of = lambda found: found.column("key")[0].as_py()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def exchange(turn: int, placed: DataFrame, answers: DataFrame | None) -> DataFrame:
        def first(found: pa.Table) -> pa.Table:
            return again(found, None)

        def again(found: pa.Table, told: pa.Table | None) -> pa.Table:
            if not found.num_rows or key_of(found) < 0:
                return _batch([], UP)
            return seat_class(key_of(found), found, told, types, shards, [seed, turn])

        def root(found: pa.Table) -> pa.Table:
            return seat_root(found, types, turn == EXCHANGES - 1, [seed, turn, 1])

        by_class = placed.groupBy("key")
        up = by_class.applyInArrow(first, UP) if answers is None else by_class.cogroup(answers.groupBy("key")).applyInArrow(again, UP)
        return up.groupBy("shard").applyInArrow(root, DOWN)

    def score(found: pa.Table, told: pa.Table) -> pa.Table:
        if not found.num_rows or key_of(found) < 0:
            return found
        rows = score_class(key_of(found), found, told, types, shards, [seed, EXCHANGES])
        return pa.table([pa.array([key_of(found)] * len(rows), pa.int32()), pa.array([r for r, _ in rows], pa.int64()), pa.nulls(len(rows), found.schema.field("ids").type), pa.array([x for _, x in rows], pa.binary())], schema=found.schema)

    # one plan, so that the shuffle of the runs is written once and read by every exchange
    placed, answers = placed_runs(docs, shared, classes), None
    for turn in range(EXCHANGES):
        answers = exchange(turn, placed, answers)
    scored = placed.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(score, PLACED.format(kind))
    return scored.groupBy("run").applyInArrow(
        lambda found: summed(found, n, denominator), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _totals(words: DataFrame) -> tuple[int, int, int]:
    """(tokens, types, the count from which at most ``2 ** HEAD`` words are frequent)."""
    step = 1 << 12
    sizes = words.groupBy(F.least("n", F.lit(step)).alias("n")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"))
    rows = sorted(((r.n, r.types, r.tokens) for r in sizes.collect()), reverse=True)  # 4096 rows at most
    n, types = sum(r[2] for r in rows), sum(r[1] for r in rows)
    least, together = max(step, -(-n >> HEAD)), 0
    for count, some, _ in rows:
        together += some
        if together > 1 << HEAD:
            break
        least = count
    return n, types, max(1, least)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_shared.table(spark, sf_dir, "documents"))
