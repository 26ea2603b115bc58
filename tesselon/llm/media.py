"""Media columns (op 6): texts as payloads of progressive JPEG images, and the tensors of those images.

The payload of a text is its UTF-8 (null: empty) and bytes 32 up to a positive multiple of 192. It is written as
the coefficients of a progressive image, read back from the file, and the image's RGB tensor gives the features.
Work is one row at a time, so memory is bounded by the longest text. Repeated rows give equal rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .textcore import text_rows, texts_of

UNIT = 192
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def payload_of(text: bytes) -> bytes:
    n = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + b" " * (n - len(text))


def feature_of(tensor: np.ndarray) -> str:
    """Width x height, the sum of each channel, and the sums of absolute steps across and down in green."""
    green = tensor[..., 1].astype(np.int16)
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
    across, down = (int(np.abs(np.diff(green, axis=k)).sum(dtype=np.int64)) for k in (1, 0))
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{','.join(map(str, sums))}:{across},{down}"


def columns(docs: DataFrame, keep: bool = False) -> DataFrame:
    """One row per row of docs; with keep also media (the file), height, width and rgb (the tensor's bytes)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary, height int, width int, rgb binary" * keep

    def row(text: bytes) -> tuple:
        media = jpeg.write(payload_of(text))
        image = jpeg.read(media)
        back = jpeg.stored(image)
        tensor = jpeg.rgb(image)
        own = (
            len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]),
            len(media), hashlib.sha256(media).hexdigest(), feature_of(tensor),
        )
        return (*own, media, tensor.shape[0], tensor.shape[1], tensor.tobytes()) if keep else own

    kinds = _KINDS + [pa.binary(), pa.int32(), pa.int32(), pa.binary()] * keep
    names = _NAMES + ["media", "height", "width", "rgb"] * keep
    slice_rows = 64 if keep else 4096

    def run(rows):
        for batch in rows:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                made = list(zip(*map(row, texts_of(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(made, kinds))], names)

    return text_rows(docs).mapInArrow(run, schema)
