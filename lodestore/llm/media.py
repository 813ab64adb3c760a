"""Media columns: payloads stored as lossless WebP images and read back.

A payload is padded with zero bytes to a positive multiple of 64; four bytes are
the samples of one pixel, sixteen pixels a row.  Payloads of more rows than an
image may have become several images, one file after another.

An image is stored with the predictor or cross-colour transform where its samples
then take fewer bits, with a palette where it has few colours, else without; the
file says which, and reading inverts it.

Features are computed from the pixels that were read back: the number of images
and rows, the mean of each channel and a histogram of the samples' high halves.

Defined cases: null bytes count as empty; an empty payload is one row of zeros;
equal payloads give equal files; a null id stays null; an empty table gives an
empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared, webp

BLOCK, WIDTH, MOST_ROWS = 64, 16, 16384
#: Block size of predictor and cross-colour transforms as a power of two, and the bits that one takes in a file.
LARGE, COST = 9, 60


def _bits(samples: np.ndarray) -> float:
    """About how many bits a code for these samples takes, its own lengths included."""
    n = np.bincount(samples.reshape(-1), minlength=256)
    n = n[n > 0]
    return float(samples.size * np.log2(samples.size) - (n * np.log2(n)).sum() + 6 * len(n))


def transforms_of(pixels: np.ndarray) -> list | None:
    """The transforms after which an image's samples take the fewest bits, None where none is better than none."""
    height = len(pixels) // WIDTH
    samples = pixels.view(np.uint8).reshape(-1, 4)
    least, best = _bits(samples), None
    across = [-(-WIDTH >> LARGE) * -(-height >> LARGE)]
    for mode in (1, 2):
        bits = _bits(webp.plain_residual(pixels, WIDTH, mode).view(np.uint8)) + COST
        if bits < least:
            least, best = bits, [("predictor", LARGE, [mode << 8 | webp.BLACK] * across[0])]
    blue, green, red, alpha = samples.T
    signed = green.view(np.int8).astype(np.int16)
    for share in (16, 32):  # of green in red and blue, by 32nds
        owed = (signed * share >> 5).astype(np.uint8)
        bits = _bits(np.concatenate([green, alpha, red - owed, blue - owed])) + COST
        if bits < least:
            least, best = bits, [("cross", LARGE, [share << 8 | share | webp.BLACK] * across[0])]
    return best


def encode_payload(data: bytes) -> bytes:
    padded = data + bytes(-len(data) % BLOCK if data else BLOCK)
    pixels = np.frombuffer(padded, dtype="<u4")
    step = WIDTH * MOST_ROWS
    files = []
    for i in range(0, len(pixels), step):
        part = pixels[i : i + step]
        distinct = len(np.unique(part))
        few = len(part) >= 256 and distinct <= 16
        files.append(_smallest(part, [("palette",)] if few else transforms_of(part), distinct))
    return b"".join(files)


def _smallest(pixels: np.ndarray, transforms: list | None, distinct: int) -> bytes:
    """The file with these transforms, or without any if that is no longer."""
    height, few = len(pixels) // WIDTH, transforms == [("palette",)]
    data = webp.encode(pixels, WIDTH, height, transforms=transforms, alike=not few, distinct=distinct)
    if transforms and not few:
        plain = webp.encode(pixels, WIDTH, height, alike=True, distinct=distinct)
        data = plain if len(plain) <= len(data) else data
    return data


def decode_media(media: bytes) -> list[np.ndarray]:
    """The pixel arrays (rows, 16, 4 samples as stored: payload order) of a stored payload."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pixels, width, height = webp.decode(media[at : at + size])
        out.append(pixels.astype("<u4").view(np.uint8).reshape(height, width, 4))
        at += size
    return out


def feature(images: list[np.ndarray]) -> str:
    samples = np.concatenate([x.reshape(-1, 4) for x in images])
    means = samples.mean(axis=0)
    histogram = np.bincount((samples >> 4).reshape(-1), minlength=16)
    return f"images={len(images)};rows={sum(len(x) for x in images)};mean=" + ",".join(f"{m:.3f}" for m in means) + ";histogram=" + ",".join(map(str, histogram.tolist()))


def store(rows: DataFrame, id_column: str, bytes_column: str) -> DataFrame:
    """id, n_bytes (unpadded) and ``media`` (binary) of every row."""

    def run(batches):
        for b in batches:
            found = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([encode_payload(x) for x in found], pa.binary())], [id_column, "n_bytes", "media"]
            )

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, bytes_column).mapInArrow(_shared.released(run), f"{id_column} {kind}, n_bytes long, media binary")


def read_back(stored: DataFrame, id_column: str) -> DataFrame:
    """Digests of the payload in each ``media`` value, and its feature."""
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for media in b.column(2).to_pylist():
                images = decode_media(media)
                payload = b"".join([x.tobytes() for x in images])
                for c, v in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    kind = stored.schema[id_column].dataType.simpleString()
    return stored.select(id_column, "n_bytes", "media").mapInArrow(
        _shared.released(run), f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return read_back(store(docs, "doc_id", "payload"), "doc_id")
