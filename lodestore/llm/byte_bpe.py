"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

Each match of the splitting pattern is encoded by itself.  The tree's leaves are
the byte positions; a leaf holds the rank of the pair that starts there, an inner
node the least rank below it, the leftmost on ties.  A merge takes the root's
pair, joins two live neighbours and updates the three leaves concerned, so a
match of n bytes takes O(n log n) steps however long it is.  Encodings of short
matches are remembered, up to a bound.

Defined cases: a null text counts as empty; an empty text has no ids; special
tokens in a text are ordinary text; code points that UTF-8 lacks (lone
surrogates) are encoded as the replacement character; repeated rows are encoded one
by one; a null id stays null; an empty table gives an empty one; other columns are
left out.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import _shared

NONE = 1 << 60
#: Matches of more bytes than this are not remembered; the memory is emptied at so many entries.
SHORT, REMEMBERED = 64, 800_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: leftmost lowest-ranked pairs are merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    end = list(range(1, n + 1))  # of the part that starts at a live position
    before = list(range(-1, n - 1))  # start of the part before it
    # (rank, position) in one number: the least is the lowest rank, leftmost on ties
    shift = n.bit_length()
    mask = (1 << shift) - 1
    get = ranks.get
    level = [NONE] * size
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            level[i] = r << shift | i
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [NONE]
    for level in reversed(levels):
        tree += level
    while (least := tree[1]) != NONE:
        i = least & mask
        j = end[i]
        stop = end[i] = end[j]
        right = None
        if stop < n:
            before[stop] = i
            right = get(piece[i : end[stop]])
        h = before[i]
        changes = [(i, right), (j, None)]
        if h >= 0:
            changes.append((h, get(piece[h:stop])))
        for at, rank in changes:
            value = NONE if rank is None else rank << shift | at
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes texts by a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes = {str(i): b for b, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.memory: dict[str, str] = {}

    def encoded(self, text: str | None) -> list[str]:
        """The ids of each match, in decimal and joined by commas."""
        if not text:
            return []
        matches = self.find(text)
        get = self.memory.get
        out = [get(m) for m in matches]
        if None in out:
            out = [x if x is not None else self._new(m) for x, m in zip(out, matches, strict=True)]
        return out

    def _new(self, match: str) -> str:
        found = self.memory.get(match)
        if found is None:
            found = ",".join(map(str, encode_piece(match.encode("utf-8", "replace"), self.ranks)))
            if len(match) <= SHORT:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[match] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.encoded(text) for i in part.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[str(i)] for i in ids])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row."""

    def run(batches):
        codec = Codec(path, pattern)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(_shared.released(run), f"{id_column} {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """doc_id and ``decoded`` (binary) of every row of ids; null ids give empty bytes."""

    def run(batches):
        codec = Codec(path, pattern)
        for b in batches:
            found = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], [id_column, "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(_shared.released(run), f"{id_column} {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns the digests of both."""

    def run(batches):
        codec = Codec(path, pattern)
        back = codec.bytes
        for b in batches:
            n, ids, decoded = [], [], []
            for text in b.column(1).to_pylist():
                joined = ",".join(codec.encoded(text))
                parts = joined.split(",") if joined else []
                n.append(len(parts))
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([back[i] for i in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_shared.released(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _shared.table(spark, sf_dir, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
