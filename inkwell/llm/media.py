"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized NPY tiles and difference hashes."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a row in images made from texts; payloads are padded to a multiple of it.
ROW = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey Netpbm file (P5) of an 8-bit array of rows."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 8-bit BMP with a grey palette, rows from the bottom up."""
    height, width = samples.shape
    body = np.zeros((height, -(-width // 4) * 4), np.uint8)
    body[:, :width] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    grey[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 256)
    return head + info + grey.tobytes() + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array: (rows, columns) for bitmaps and grey, (rows, columns, 3) for colour.

    Samples keep their values (8 or 16 bits); a bitmap's 1 is black, so it becomes 0 and its 0 becomes 255.
    """
    kind, at, numbers = data[1:2], 2, []
    field = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")
    while len(numbers) < (2 if kind in b"14" else 3):
        m = field.match(data, at)
        if not m:
            raise ValueError("Netpbm header cut short")
        numbers.append(int(m[1]))
        at = m.end()
    width, height = numbers[:2]
    depth = 3 if kind in b"36" else 1
    if kind == b"1":
        bits = np.frombuffer(re.sub(rb"[^01]", b"", data[at:]), np.uint8)[: width * height] - 48
        out = np.where(bits == 1, 0, 255).astype(np.uint8)
    elif kind in b"23":
        out = np.array(data[at:].split()[: width * height * depth], dtype=np.int64).astype(np.uint16 if numbers[2] > 255 else np.uint8)
    elif kind == b"4":
        stride = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        out = np.where(np.unpackbits(rows, axis=1)[:, :width] == 1, 0, 255).astype(np.uint8).ravel()
    elif kind in b"56":
        out = np.frombuffer(data, ">u2" if numbers[2] > 255 else np.uint8, width * height * depth, at + 1)
    else:
        raise ValueError("not Netpbm")
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits as (rows, columns) if all its colours are grey, else (rows, columns, 3) RGB."""
    start, size, width, height, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}, isn't read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
        index = rows[:, :width]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][index]
        return palette[index]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> tuple[str, np.ndarray]:
    """('netpbm' or 'bmp', array); ValueError for other or broken bytes."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return "netpbm", decode_netpbm(data)
        if data[:2] == b"BM":
            return "bmp", decode_bmp(data)
    except (struct.error, IndexError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each output sample is the mean of the area it covers, by an integral image read at fractional corners."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(grey, axis=0, out=table[1:, 1:])
    np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
    for n, axis in ((height, 0), (width, 1)):
        edge = np.linspace(0, table.shape[axis] - 1, n + 1)
        low = np.minimum(edge.astype(np.int64), table.shape[axis] - 2)
        part = (edge - low)[:, None] if axis == 0 else edge - low
        a, b = np.take(table, low, axis), np.take(table, low + 1, axis)
        table = a + part * (b - a)
    area = (grey.shape[0] / height) * (grey.shape[1] / width)
    return (table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: in an 8 by 9 area-resized image, whether a sample is brighter than its left neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def text_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with its texts stored losslessly as images in column `media`, in place of the text column.

    The UTF-8 bytes, padded by zeros to a positive multiple of 64, are the 8-bit samples of an image 64 wide: a BMP
    where the payload's crc32 is odd, else a binary PGM. n_bytes: the bytes before padding. A null text counts as
    empty, so no row is lost; equal texts give equal images. Other columns stay; a column called `media` or n_bytes is
    replaced.
    """
    keep = [c for c in df.columns if c not in (text, media, "n_bytes")]
    shape = df.select(*keep).schema.add(media, "binary").add("n_bytes", "long")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, sizes = [], []
            for raw in batch.column(len(keep)).to_pylist():
                payload = raw + bytes(-len(raw) % ROW or (0 if raw else ROW))
                samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
                images.append((encode_bmp if zlib.crc32(payload) & 1 else encode_pgm)(samples))
                sizes.append(len(raw))
            arrays = [*batch.columns[: len(keep)], pa.array(images, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, media, "n_bytes"])

    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__raw")
    return df.select(*keep, raw).mapInArrow(store, shape)


def media_tiles(df: DataFrame, media: str = "media", tile: int = 32, samples: bool = False) -> DataFrame:
    """df with format, height, width, channels, tile_npy, dhash and error for the images in column `media`.

    tile_npy is an NPY file of the image area-resized to tile x tile 8-bit samples; dhash its 64-bit difference hash.
    Null, empty or unreadable bytes give nulls and the reason in error; an image without samples is such a case. With
    samples, the decoded array's bytes come too. Columns of these names are replaced, others stay.
    """
    made = ["format", "height", "width", "channels", "tile_npy", "dhash", "error"] + ["samples"] * samples
    keep = [c for c in df.columns if c not in made]
    kinds = dict(zip(made, ("string", "integer", "integer", "integer", "binary", "string", "string", "binary"), strict=False))
    shape = df.select(*keep).schema
    for name in made:
        shape = shape.add(name, kinds[name])
    at = keep.index(media)
    arrow = {"string": pa.string(), "integer": pa.int32(), "binary": pa.binary()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(at).to_pylist():
                try:
                    kind, image = decode(bytes(data or b""))
                    if not image.size:
                        raise ValueError("no samples")
                    small = np.clip(np.rint(area_resize(image, tile, tile)), 0, 255).astype(np.uint8)
                    row = [kind, *image.shape[:2], image.shape[2] if image.ndim == 3 else 1, npy_bytes(small), difference_hash(image), None, image.tobytes()]
                except ValueError as e:
                    row = [None] * 6 + [str(e)[:200], None]
                rows.append(row[: len(made)])
            columns = zip(*rows, strict=True) if rows else [[] for _ in made]
            arrays = [*batch.columns[: len(keep)], *(pa.array(list(c), arrow[kinds[n]]) for n, c in zip(made, columns, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    return df.select(*keep).mapInArrow(describe, shape)


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's text as an image, read back: sizes, digests and the image's difference hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tiles = media_tiles(text_media(docs), samples=True)
    # Padding zeros end the samples, so the last 64 bytes are cut by position.
    tail = F.expr(f"substring(samples, length(samples) - {ROW - 1}, {ROW})")
    return tiles.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "format", "dhash", F.sha2("tile_npy", 256).substr(1, 16)).alias("feature"),
    )
