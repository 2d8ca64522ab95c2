"""Media columns: texts as lossless WebP images, stored images as pixel arrays, and their features."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import text_or_empty

#: Bytes of one row of pixels: payloads are filled up with 255 to a multiple of it.
UNIT = 3 * webp.WIDTH
#: Texts that are stored together, pixels that are read together (long images fill a step with many others).
_ROWS, _PIXELS = 1024, 1 << 22


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def stored(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one file, or one behind the other where an image would be too tall."""
    step = UNIT * webp.TALL
    parts = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    files = iter(webp.encode_smallest([x for p in parts for x in p]))
    return [b"".join(next(files) for _ in p) for p in parts]


def pixels(media: list[bytes]) -> list[bytes]:
    """Red, green and blue of every pixel of each stored form."""
    parts = []
    for m in media:
        own, at = [], 0
        while at < len(m):
            end = at + 8 + struct.unpack("<I", m[at + 4 : at + 8])[0]
            own.append(m[at:end])
            at = end
        parts.append(own)
    found = iter(webp.decode_batch([x for p in parts for x in p]))
    return [b"".join(next(found) for _ in p) for p in parts]


def features(payloads: list[bytes]) -> list[str]:
    """Of each: mean, deviation and mean step to the next pixel of each channel, and the share of filled pixels."""
    a = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3).astype(np.int32)
    n = np.array([len(p) // 3 for p in payloads])
    starts = n.cumsum() - n
    steps = np.abs(np.diff(a, axis=0, append=a[-1:]))
    steps[starts + n - 1] = 0
    total, square, step = (np.add.reduceat(v, starts, axis=0, dtype=np.int64) for v in (a, a * a, steps))
    full = np.add.reduceat(a.min(axis=1) == 255, starts, dtype=np.int64) / n
    n = n[:, None]
    rows = np.concatenate([total / n, np.sqrt(n * square - total * total) / n, step / np.maximum(n - 1, 1), full[:, None]], axis=1)
    return [" ".join(f"{v:.4f}" for v in row) for row in rows.tolist()]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            texts = part.column("text").to_pylist()
            files = stored([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, at = np.cumsum([webp.area(f.as_py()) for f in batch.column("media")]), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PIXELS, side="right")))
            part = batch.slice(at, end - at)
            at = end
            data = pixels(part.column("media").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary()), pa.array([f for i in range(0, len(data), 64) for f in features(data[i : i + 64])], pa.string())], names=[*part.schema.names, "pixels", "feature"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each row's text (null: empty) as one lossless WebP, a pure function of the text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """media with pixels (bytes, three to a pixel) and feature, from the stored bytes of column `media`."""
    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(_load, "doc_id long, n_bytes long, media binary, pixels binary, feature string")
