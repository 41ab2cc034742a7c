"""Media columns: payloads as GIF, and timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, small_batches, written
from plumbline.llm.gif import Gif, canvases, decode, encode_rows

ROW, FRAME_ROWS, DELAY_MS = 192, 1024, 40
#: Bins a colour channel: 4 x 4 x 4 colours.
BINS = 4

#: What decoding says of bytes that are no GIF, or end in the midst of a number.
BROKEN = (ValueError, IndexError, struct.error)

FRAMES = "media_id long, frame int, start_ms long, delay_ms int, width int, height int, disposal int, transparent int, histogram array<int>, visible long"


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with spaces up to a positive multiple of ROW."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as grey GIF rows of ROW samples. A null text is an empty one."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                text = text.as_py()
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                media.append(encode_rows(payload_of(text), ROW, FRAME_ROWS, DELAY_MS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def samples(gif: Gif) -> bytes:
    """The grey samples of all frames in the order of time, each through its palette."""
    return b"".join([f.palette[:, 0][f.indexes].tobytes() for f in gif.frames])


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Pixels by colour, of those that can be seen."""
    flat = rgba.reshape(-1, 4)
    flat = flat[flat[:, 3] > 0].astype(np.int64) * BINS >> 8
    return np.bincount((flat[:, 0] * BINS + flat[:, 1]) * BINS + flat[:, 2], minlength=BINS**3)


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row a frame of every GIF: when it is shown, its size and transparency, and the histogram of what is seen then.

    A null medium and bytes that are no GIF give no rows; a file that breaks off
    gives the frames before. Repeated media give repeated rows.
    """
    small_batches(media.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    gif = decode(data.as_py() or b"")
                except BROKEN:
                    continue
                at = 0
                for k, (f, seen) in enumerate(zip(gif.frames, canvases(gif))):
                    h = histogram(seen)
                    rows.append((key, k, at, f.delay_ms, f.width, f.height, f.disposal, f.transparent, h.tolist(), int(h.sum())))
                    at += f.delay_ms
            names = [x.split()[0] for x in FRAMES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(explode, FRAMES)


#: What is told of a frame beside its medium: when it is shown and for how long, the pixels seen then and their colours.
SHOWN = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("visible", pa.int64()), ("histogram", pa.list_(pa.int32()))]))


def shown(gif: Gif) -> list[dict]:
    """The timed frames of a GIF as they are seen: palettes applied, transparency left out, disposed of one after another."""
    out, at = [], 0
    for f, seen in zip(gif.frames, canvases(gif)):
        h = histogram(seen)
        out.append({"start_ms": at, "delay_ms": f.delay_ms, "visible": int(h.sum()), "histogram": h.tolist()})
        at += f.delay_ms
    return out


def _told(data: bytes | None) -> tuple | None:
    try:
        gif = decode(data or b"")
    except BROKEN:
        return None
    payload, seen = samples(gif), shown(gif)
    grey = np.bincount(np.frombuffer(payload, dtype=np.uint8) >> 4, minlength=16)
    colours = np.sum([x["histogram"] for x in seen], axis=0).tolist() if seen else []
    feature = f"gif;frames={len(seen)};ms={sum(x['delay_ms'] for x in seen)};grey16=" + ",".join(map(str, grey.tolist()))
    feature += ";colours64=" + ",".join(f"{k}:{n}" for k, n in enumerate(colours) if n)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, seen


def read_back(media: DataFrame) -> DataFrame:
    """Digests, features and timed frames from the stored bytes alone.

    The feature is of the samples after decoding and of the colours of all
    frames as they are seen. A null medium and bytes that are no GIF give nulls.
    """
    small_batches(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<start_ms: long, delay_ms: int, visible: long, histogram: array<int>>>"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), SHOWN]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_told(data.as_py()) or (None,) * len(kinds) for data in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(digest, schema)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(store_texts(documents(spark, sf_dir)), "media"))
