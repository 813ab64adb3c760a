"""Packing: bounded-space best-fit of tokenised documents into sequences of fixed length.

Every scan partition keeps at most ``window_count`` open windows.  A document's
ids (with its end id) are cut into full sequences and a rest; the rest goes into
the open window that it fills best.  When none has room and all windows are open,
the fullest is emitted; if its gap is at least ``min_cut``, the rest is cut to
close it first.  A window that is full is emitted at once.  At the end the open
windows of neighbouring partitions, of which there are at most ``window_count`` a
partition, are merged best-fit, largest first.  Only rows of pieces are moved,
never ids.

Ids are those of the tokenizer library without added special tokens; a special
token's name in a text is that token, as the library has it.

Defined cases: a null or empty text is its end id alone; a null doc_id stays
null; repeated rows are packed one by one; an empty table gives an empty one; other
columns are left out.  Sequence ids are unique but have gaps.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared

#: White space at which words can be encoded apart: the tokenizer drops it and no merge crosses it.
GAP = re.compile(r"[ \t\n\r]+")
_LETTER, _NUMBER, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\x0b\x0c\r \x85\xa0"
#: The tokenizer's pre-tokens, for texts below code point 256, where case, letters and numbers are settled.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Parts that a generation of the memory holds, and the longest that are remembered.
MEMORY, SHORT = 150_000, 64
TOGETHER = 64


class WordEncoder:
    """Ids of a text by a tokenizer that drops white space; distinct parts are encoded once, up to a bound.

    A part is a pre-token or, in texts with code points from 256 on, a word.  The
    memory has two generations of ``MEMORY`` parts: when the younger is full it
    becomes the older, and what is used again moves back.  A text that holds one
    of the tokenizer's special tokens goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[ends] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(t in text for t in self.special):
            return [text]
        if text.isascii() or max(text) < "\u0100":
            return PIECE.findall(text.lower())
        return [w for w in GAP.split(text) if w]

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of each part."""
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out, new = {}, []
        for w in parts:
            ids = young.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    new.append(w)
                    continue
                young[w] = ids
            out[w] = ids
        single = [w for w in new if PIECE.fullmatch(w)]  # one pre-token, so one id with a word end, its last
        rest = [w for w in new if not PIECE.fullmatch(w)]
        found: dict[str, bytes] = {}
        for i in range(0, len(single), 256 * TOGETHER):
            groups = [single[k : k + TOGETHER] for k in range(i, min(i + 256 * TOGETHER, len(single)), TOGETHER)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stops) != len(group):
                    rest += group
                    continue
                data, at = ids.tobytes(), 0
                for w, stop in zip(group, stops, strict=True):
                    found[w] = data[4 * at : 4 * stop]
                    at = stop
        for i in range(0, len(rest), 5000):
            some = rest[i : i + 5000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, dtype="<u4").tobytes()
        young.update((w, ids) for w, ids in found.items() if len(w) <= SHORT)
        out.update(found)
        return out

    def batch(self, texts: list[str | None], end_id: int):
        """For each text its ids as little-endian 32-bit numbers, the end id last."""
        tail = np.array([end_id], dtype="<u4").tobytes()
        group: list[list[str]] = []
        distinct: set[str] = set()

        def flush():
            get = self.learn(distinct).__getitem__
            for found in group:
                yield b"".join(map(get, found)) + tail

        size = 0
        for text in texts:
            found = self.parts(text)
            group.append(found)
            distinct.update(found)
            size += len(text or "")
            if size > 1_000_000:
                yield from flush()
                group, distinct, size = [], set(), 0
        yield from flush()


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker process for all tasks that it runs; a task leaves its memory empty."""
    return WordEncoder(path)


class Windows:
    """Open windows by room left; emitting gives (window number, fill)."""

    def __init__(self, length: int, count: int, min_cut: int):
        self.length, self.count, self.min_cut = length, count, min_cut
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int):
        """Yields (window, offset, part) of the pieces that a rest of ``size`` ids becomes."""
        while size:
            at = bisect_left(self.room, (size, -1))
            if at == len(self.room) and len(self.room) >= self.count:
                room, window = self.room.pop(0)  # the fullest is emitted
                if room >= self.min_cut:
                    yield window, self.length - room, room
                    size -= room
                continue
            room, window = self.room.pop(at) if at < len(self.room) else (self.length, self.new())
            yield window, self.length - room, size
            if room > size:
                insort(self.room, (room - size, window))
            return


PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, part int, win long, offset long, open boolean"


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, window_count: int = 64, min_cut: int = 16, fan_in: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        encoder = encoder_of(path)
        encoder.young, encoder.old = {}, {}
        windows = Windows(length, window_count, min_cut)
        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def frame(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [id_type, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.batch(b.column(1).to_pylist(), end_id), strict=True):
                total = len(ids) // 4
                start = 0
                while total - start >= length:
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, part, windows.new(), 0, False))
                    start += length
                for window, offset, size in windows.place(total - start):
                    held.setdefault(window, []).append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, part, window, offset))
                    start += size
            if len(held) > 4 * window_count:
                still = {w for _, w in windows.room}
                for w in [w for w in held if w not in still]:
                    rows += [(*x, False) for x in held.pop(w)]
            yield frame(rows)
        encoder.young, encoder.old = {}, {}
        still = {w for _, w in windows.room}
        yield frame([(*x, w in still) for w, found in held.items() for x in found])

    pieces = _shared.written(docs.select("doc_id", "text").mapInArrow(_shared.released(run), PIECES.format(kind)))
    numbered = F.col("part").cast("long") * F.lit(1 << 36) + F.col("win")

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["fill", "part", "win"], ascending=[False, True, True])
        room: list[tuple[int, int]] = []
        out = []
        for part, win, fill in zip(found.part.tolist(), found.win.tolist(), found.fill.tolist(), strict=True):
            at = bisect_left(room, (fill, -1))
            left, target = room.pop(at) if at < len(room) else (length, part * (1 << 36) + win)
            out.append((part, win, target, length - left))
            if left > fill:
                insort(room, (left - fill, target))
        return pd.DataFrame(out, columns=["part", "win", "target", "base"])

    open_pieces = pieces.where("open")
    moved = (
        open_pieces.groupBy("part", "win").agg(F.sum("length").alias("fill"))
        .groupBy(F.floor(F.col("part") / fan_in).alias("near")).applyInPandas(merge, "part int, win long, target long, base long")
    )
    placed = open_pieces.join(moved, ["part", "win"]).select(
        *names[:5], F.col("target").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset")
    )
    closed = pieces.where("not open").select(*names[:5], numbered.alias("sequence_id"), "offset")
    return closed.unionByName(placed)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
