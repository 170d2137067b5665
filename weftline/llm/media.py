"""Media columns: Netpbm and BMP bytes to arrays, area resize by integral images, NPY tiles, difference hashes.

Edge cases: null media gives nulls and the error ``null``; undecodable or truncated media gives nulls and
the error's text; images of no pixels are an error; equal bytes give equal values; empty tables give empty
tables; extra columns are ignored (only the two named ones are read).
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_rows, keyed

WIDTH = 64  # samples in a row of a stored payload


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The next `count` decimal fields of a Netpbm header after its magic, with comments; and where they end."""
    fields, at = [], 2
    while len(fields) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[start:at]))
    return fields, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, plain, planes = kind in (1, 4), kind <= 3, 3 if kind in (3, 6) else 1
    fields, at = _header(data, 2 if bitmap else 3)
    width, height, top = fields[0], fields[1], 1 if bitmap else fields[2]
    if not width or not height or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    count = width * height * planes
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        parts = [b % 2 for b in body if b in b"01"] if bitmap else [int(x) for x in body.split()]
        samples = np.array(parts[:count], np.int64)
    elif bitmap:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)
        if raw.size < row * height:
            raise ValueError("truncated Netpbm")
        samples = np.unpackbits(raw[: row * height].reshape(height, row), axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data[at + 1 : at + 1 + count * (1 + (top > 255))], ">u2" if top > 255 else np.uint8)
    if samples.size < count:
        raise ValueError("truncated Netpbm")
    if bitmap:
        samples, top = 1 - samples.astype(np.int64), 1
    out = samples[:count].reshape((height, width, planes) if planes > 1 else (height, width))
    return out if top == 255 and out.dtype == np.uint8 else np.rint(out.astype(np.float64) * 255 / top).clip(0, 255).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("truncated BMP")
    start, head, width, height, _, depth, packing, _, _, _, used = struct.unpack_from("<I IiiHHIIiiI", data, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, offset=min(start, len(data)))
    if raw.size < stride * rows:
        raise ValueError("truncated BMP")
    lines = raw[: stride * rows].reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if depth >= 24:
        return lines[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)[:, :width]
    index = bits @ (1 << np.arange(depth)[::-1])
    palette = np.frombuffer(data, np.uint8, count=4 * (used or 1 << depth), offset=14 + head).reshape(-1, 4)[:, 2::-1]
    out = palette[index]
    grey = (palette == palette[:, :1]).all()
    return out[:, :, 0] if grey else out


def decode(data: bytes) -> np.ndarray:
    """Samples as uint8: (height, width) for grey, (height, width, 3) for colour."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means: the integral image is piecewise linear, so its value at fractional edges is interpolated."""
    planes = image if image.ndim == 3 else image[:, :, None]
    total = np.zeros((planes.shape[0] + 1, planes.shape[1] + 1, planes.shape[2]))
    np.cumsum(np.cumsum(planes, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(table: np.ndarray, size: int, parts: int) -> np.ndarray:
        edges = np.arange(parts + 1) * (size / parts)
        low = np.minimum(edges.astype(np.int64), size - 1)
        part = (edges - low).reshape(-1, 1, 1)
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(total, planes.shape[0], height)
    both = at(rows.swapaxes(0, 1), planes.shape[1], width).swapaxes(0, 1)
    sums = np.diff(np.diff(both, axis=0), axis=1)
    out = sums * (height * width / (planes.shape[0] * planes.shape[1]))
    return out if image.ndim == 3 else out[:, :, 0]


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells of the grey 8 x 9 area means is darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    grey = small.mean(2) if small.ndim == 3 else small
    return np.packbits(np.round(grey[:, :-1], 6) < np.round(grey[:, 1:], 6)).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), array, allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, side: int) -> bytes:
    return npy(np.rint(area_resize(image, side, side)).clip(0, 255).astype(np.uint8))


FEATURES = "height int, width int, planes int, samples_bytes long, samples_sha256 string, tail_crc32 long, tile binary, dhash string, error string"


def media_features(media: DataFrame, id_col: str, media_col: str, tile_side: int = 16) -> DataFrame:
    """Decodes each media value and returns its size, digests of its samples, an NPY tile and a difference hash."""
    source = media.select(F.col(id_col).alias("media_id"), F.col(media_col).cast("binary").alias("media"))
    schema = pa.schema(
        [(n, t) for n, t in zip(
            ("height", "width", "planes", "samples_bytes", "samples_sha256", "tail_crc32", "tile", "dhash", "error"),
            (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()), strict=True,
        )]
    )

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8 + ("null",)
        try:
            image = decode(data)
        except (ValueError, IndexError, struct.error) as e:
            return (None,) * 8 + (str(e) or "bad media",)
        raw = image.tobytes()
        planes = image.shape[2] if image.ndim == 3 else 1
        return (
            image.shape[0], image.shape[1], planes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]),
            tile_of(image, tile_side), difference_hash(image), None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(1)]
            found = arrow_rows(schema, list(zip(*rows, strict=True)) or [[]] * 9)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *found.columns], names=["media_id", "media", *schema.names]
            )

    key = source.schema["media_id"].dataType.simpleString()
    return source.mapInArrow(run, f"media_id {key}, media binary, {FEATURES}")


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8, zeros up to a positive multiple of 64, as an 8-bit PGM of 64 samples a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).cast(pa.binary()):
                data = text.as_py()
                rows = max(1, -(-len(data) // WIDTH))
                padded = data.ljust(rows * WIDTH, b"\0")
                sizes.append(len(data))
                media.append(encode_pgm(np.frombuffer(padded, np.uint8).reshape(rows, WIDTH)))
            yield arrow_rows(schema, [batch.column(0), sizes, media])

    return keyed(docs, id_col, text_col).mapInArrow(run, "media_id long, n_bytes long, media binary")


def op10_media(spark, sf_dir: str) -> DataFrame:
    stored = store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    packed = stored.withColumn("media_id", F.struct("media_id", "n_bytes"))
    return media_features(packed, "media_id", "media").select(
        F.col("media_id.media_id").alias("doc_id"),
        F.col("media_id.n_bytes").alias("n_bytes"),
        F.col("samples_bytes").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"),
        "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.md5("tile")).alias("feature"),
    )
