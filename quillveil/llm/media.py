"""Media columns: payloads to lossless WebP files, and WebP files to pixel arrays with features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk
from quillveil.llm import webp

UNIT = 64
#: Pixels of a row of the smallest image.
_ROW_PIXELS = 16


def payload_of(raw: np.ndarray) -> np.ndarray:
    """The bytes with zeros up to a positive multiple of 64."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    out = np.zeros(size, np.uint8)
    out[: len(raw)] = raw
    return out


#: Bytes of a payload in one image; what is longer goes on in further ones, which follow one another in the stored form.
MOST_BYTES = 4 * webp.MAX_SIDE**2


def encode_payload(payload: np.ndarray, most: int = MOST_BYTES) -> bytes:
    """The images of a payload, one file after the other."""
    return b"".join(webp.encode(pixels_of(payload[a : a + most])) for a in range(0, len(payload), most))


#: Payloads and files up to so many bytes are remembered by a worker, the latest REMEMBERED of either, as copies of a text are.
SMALL, REMEMBERED = 1 << 16, 512


@lru_cache(maxsize=REMEMBERED)
def _encoded(payload: bytes) -> bytes:
    return encode_payload(np.frombuffer(payload, np.uint8))


@lru_cache(maxsize=REMEMBERED)
def _decoded(media: bytes) -> tuple:
    """(width, height, pixels, feature, error) of a stored form."""
    try:
        images = [webp.decode(f) for f in files_of(media)]
    except webp.WebpError as e:
        return None, None, None, None, str(e)
    return images[0].shape[1], images[0].shape[0], b"".join(i.tobytes() for i in images), ";".join(map(feature_of, images)), None


def _small(f: Callable, raw: bytes):
    """``f`` of the bytes, from memory where they are few."""
    return f(raw) if len(raw) <= SMALL else f.__wrapped__(raw)


def files_of(media: bytes) -> list[bytes]:
    """The files that follow one another, each as long as its head says."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        # what is no whole file is left to the decoder, which tells why
        end = len(media) if media[at : at + 4] != b"RIFF" or at + size > len(media) else at + size + size % 2
        out.append(media[at:end])
        at = max(end, at + 1)
    return out or [media]


def pixels_of(payload: np.ndarray) -> np.ndarray:
    """The payload as grays, a byte a pixel, in an image wider than it is high; zeros behind it fill the last row.

    What does not fit so is an image of four bytes a pixel, up to MOST_BYTES. Text is never taken
    for the other form when it is read back, as no byte of UTF-8 is an opaque alpha.
    """
    gray = len(payload) <= webp.MAX_SIDE**2
    pixels = len(payload) if gray else len(payload) // 4
    width = _ROW_PIXELS
    while width < webp.MAX_SIDE and width * width < 2 * pixels:
        width *= 2
    height = -(-pixels // width)
    if height > webp.MAX_SIDE:
        raise webp.WebpError("a payload over MOST_BYTES does not fit one image")
    out = np.zeros(height * width * (1 if gray else 4), np.uint8)
    out[: len(payload)] = payload
    return out.reshape(height, width) if gray else out.reshape(height, width, 4)


def feature_of(pixels: np.ndarray) -> str:
    """Size, mean sample, and a 64-bit average hash of the image's 64 strips."""
    flat = pixels.reshape(-1)
    bounds = np.arange(65) * len(flat) // 64
    sizes = np.diff(bounds)
    # strips of no sample, as images of under 64 have, sum up to nothing
    sums = np.add.reduceat(flat, np.minimum(bounds[:-1], len(flat) - 1), dtype=np.int64) * (sizes > 0)
    total = int(flat.sum(dtype=np.int64))
    bits = (sums * len(flat) > total * np.maximum(sizes, 1)).astype(np.uint8)
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean {total // max(len(flat), 1)} hash {np.packbits(bits).tobytes().hex()}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media) of each row; null texts are empty, and empty ones are 64 zeros.

    Equal texts give equal files. Repeated rows are stored each; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch.column("text")):
                sizes, media = np.diff(part.offsets), []
                for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
                    media.append(_small(_encoded, payload_of(part.buf[a:b]).tobytes()))
                padded = np.maximum(1, -(-sizes // UNIT)) * UNIT
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), pa.array(sizes), pa.array(padded), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, "doc_id long, n_bytes long, payload_bytes long, media binary")


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """``rows`` with width, height, pixels (raw bytes, row by row: one a pixel in images of opaque grays, else red, green, blue and alpha), feature and media_error.

    Null media have nulls there. Bytes that are no lossless WebP image have
    nulls and the reason in media_error. Of several images that follow one
    another the pixels are joined, the features parted by semicolons, and the
    size is that of the first. Other columns stay as they are; those
    of the same names, in any case, give way. The media column stays, unless it
    has one of these names itself. An empty table gives no rows.
    """
    added = ["width", "height", "pixels", "feature", "media_error"]
    source = "_media" if media_col.lower() in added else media_col
    rows = rows.select(*[f"`{c}`" for c in rows.columns if c.lower() not in added], *([F.col(media_col).alias(source)] if source != media_col else []))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["width int, height int, pixels binary, feature string, media_error string"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256  # rows whose pixels are held at once
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                cols: list[list] = [[], [], [], [], []]
                for x in part.column(source):
                    row = _small(_decoded, x.as_py()) if x.is_valid else (None,) * 5
                    for col, value in zip(cols, row):
                        col.append(value)
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(c, k) for c, k in zip(cols, kinds)], names=batch.schema.names + added)

    out = rows.mapInArrow(read, schema)
    return out.drop(source) if source != media_col else out
