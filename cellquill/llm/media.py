"""Media columns: documents as progressive JPEGs, read back to coefficients, payloads and RGB features.

``with_media`` stores each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, in a binary column; ``stored``
writes that column to the shared folder, and ``read_media`` reads it from there. ``tensors`` gives the full-resolution RGB
tensors in bands of a bounded size, to be written as a table: 3 to 4 times the bytes of the texts, so ``read_media``, which
needs the colour means only, makes them band by band and doesn't write them. Equal texts give equal media and features. A null text is stored as an empty one; null ids
are carried; repeated rows are stored once each; an empty table gives an empty result. A text of any length is one image,
whose pixels are made in strips, so memory is a few times the text's size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import small_batches, written

STRIP = 2048  # units whose pixels are made at once
ROWS = 64  # media rows in a batch


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(64 if not raw else -len(raw) % 64)


def bands(image: jpeg.Image) -> Iterator[tuple[int, np.ndarray]]:
    """The RGB tensor in bands of at most STRIP units, each with its first pixel column."""
    step = max(1, STRIP // image.rows)
    for first in range(0, image.cols, step):
        yield 8 * image.h * first, jpeg.rgb(image, first, min(first + step, image.cols))


def features(image: jpeg.Image) -> str:
    """Height, width, and the mean of each colour in 8 parts of the width, in 1/100."""
    sums, pixels = np.zeros((8, 3), np.int64), np.zeros(8, np.int64)
    for first, tensor in bands(image):
        part = np.minimum(7, (first + np.arange(tensor.shape[1])) * 8 // image.width)
        columns = tensor.sum(axis=0, dtype=np.int64)
        np.add.at(sums, part, columns)
        pixels += np.bincount(part, minlength=8) * len(tensor)
    means = 100 * sums // np.maximum(pixels, 1)[:, None]
    return f"{image.height}x{image.width}:" + "/".join(",".join(map(str, row)) for row in means.tolist())


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                got = [padded(t.as_py()) for t in part.column(1)]
                media = pa.array([jpeg.encode(raw) for _, raw in got], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``with_media`` as a written table."""
    return written(with_media(docs, id_col, text_col), "media", compression="zstd")


def read_media(stored: DataFrame) -> DataFrame:
    """Digests of the payload and of the stored form, and features of the RGB tensor, for each row of ``with_media``."""

    def one(doc, n, media: bytes) -> tuple:
        image = jpeg.decode(media)
        raw = jpeg.payload(image)
        return doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(image)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(a.as_py(), b.as_py(), c.as_py()) for a, b, c in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)] if rows else [pa.array([], k.type) for k in schema], schema=schema)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, height, width, first, rgb): the full-resolution tensor of each row of ``with_media`` in bands of pixel columns.

    A band starts at pixel column ``first`` and has at most STRIP units; its bytes are in row, column, colour order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, media in zip(batch.column(0), batch.column(1)):
                image = jpeg.decode(media.as_py())
                for first, band in bands(image):
                    cells = ([doc.as_py()], pa.int64()), ([image.height], pa.int32()), ([image.width], pa.int32()), ([first], pa.int32()), ([band.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in cells], names=["doc_id", "height", "width", "first", "rgb"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, first int, rgb binary")


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read_media(stored(table(spark, sf_dir, "documents")))
