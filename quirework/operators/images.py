"""Perceptual hashes of images: a grid of mean luminances, and whether each is above its right neighbour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns and rows of the grid, and the limits of an image.
COLUMNS, ROWS = 9, 8
MOST_BYTES, MOST_PIXELS, MOST_WHOLE_PIXELS = 52_428_800, 16_000_000, 1_000_000


def luminance(channels: np.ndarray) -> np.ndarray:
    """Whole luminances of (height, width, blue green red [alpha]) bytes over white."""
    c = channels.astype(np.int64)
    if c.shape[2] == 1:
        return c[..., 0]
    alpha = c[..., 3:4] if c.shape[2] == 4 else np.full((*c.shape[:2], 1), 255)
    over = (c[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255
    return (299 * over[..., 2] + 587 * over[..., 1] + 114 * over[..., 0]) // 1000


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as an EXIF orientation (1 to 8) shows them."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    flip_rows, flip_columns = orientation in (3, 4, 7, 8), orientation in (2, 3, 6, 7)
    return pixels[:: -1 if flip_rows else 1, :: -1 if flip_columns else 1]


def _cells(length: int, count: int) -> list[tuple[int, int]]:
    """The range of pixels of each cell; with fewer pixels than cells, pixels repeat."""
    if length >= count:
        of = np.minimum(count - 1, ((np.arange(length) + 1) * count - 1) // length)
        return [(int(np.searchsorted(of, k)), int(np.searchsorted(of, k, "right"))) for k in range(count)]
    return [(k * length // count, k * length // count + 1) for k in range(count)]


def grid(pixels: np.ndarray) -> np.ndarray:
    values = luminance(pixels)
    return np.array([[values[a:b, c:d].sum() // values[a:b, c:d].size for c, d in _cells(values.shape[1], COLUMNS)] for a, b in _cells(values.shape[0], ROWS)])


def hash_of(pixels: np.ndarray) -> str:
    g = grid(pixels)
    return "".join(f"{int(''.join('1' if x else '0' for x in row), 2):02x}" for row in g[:, :-1] > g[:, 1:])


def grid_hash(cells: Column) -> Column:
    """The hash of 72 luminances, row by row, as 16 hex digits, in built-in functions."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(cells, (F.floor(i / 8) * 9 + i % 8).cast("int")) > F.get(cells, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")), "1").otherwise("0"))
    return F.when(F.size(cells) == COLUMNS * ROWS, F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), 16, "0"))


def _hashes(heights: pd.Series, widths: pd.Series, channels: pd.Series, data: pd.Series, orientations: pd.Series) -> pd.DataFrame:
    out = []
    for h, w, n, raw, o in zip(heights, widths, channels, data, orientations, strict=True):
        if raw is None or h <= 0 or w <= 0 or len(raw) != h * w * n:
            out.append((None, "IMAGE_DECODE_FAILED"))
        elif h * w > MOST_PIXELS:
            out.append((None, "IMAGE_PIXEL_LIMIT_EXCEEDED"))
        else:
            out.append((hash_of(oriented(np.frombuffer(raw, np.uint8).reshape(h, w, n), int(o))), None))
    return pd.DataFrame(out, columns=["hash", "error_code"])


def image_hashes(images: DataFrame, orientation: Column | None = None) -> DataFrame:
    """origin, hash, error_code of rows as Spark's image source gives them; orientation is 1 where none is given."""
    hashed = F.pandas_udf(_hashes, "hash string, error_code string")
    o = F.lit(1) if orientation is None else F.coalesce(orientation, F.lit(1))
    return images.select("image.origin", hashed("image.height", "image.width", "image.nChannels", "image.data", o).alias("h")).select("origin", "h.*")


def image_limits(byte_count: Column, width: Column, height: Column, by_region: Column | None = None) -> Column:
    """The error that an image's size means, or null: bytes of the file, and pixels, fewer where it can't be read by regions."""
    most = F.when(F.lit(True) if by_region is None else by_region, MOST_PIXELS).otherwise(MOST_WHOLE_PIXELS)
    return F.when(byte_count > MOST_BYTES, "IMAGE_SIZE_LIMIT_EXCEEDED").when((width <= 0) | (height <= 0), "IMAGE_DECODE_FAILED").when(width.cast("long") * height.cast("long") > most, "IMAGE_PIXEL_LIMIT_EXCEEDED")


def _png(data: bytes) -> bool:
    at = 8
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind in (b"IDAT", b"IEND"):
            return True
        if kind == b"acTL":
            return int.from_bytes(data[at + 8 : at + 12], "big") <= 1
        at += 12 + size
    return True


def _gif(data: bytes) -> bool:
    skip = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    if len(data) < 13:
        return True
    at, frames = 13 + skip(data[10]), 0
    while at < len(data):
        if data[at] == 0x2C:
            frames += 1
            at += 10 + skip(data[at + 9] if at + 9 < len(data) else 0) + 1
        elif data[at] == 0x21:
            at += 2
        else:
            break
        while at < len(data) and data[at]:
            at += 1 + data[at]
        at += 1
    return frames <= 1


def _webp(data: bytes) -> bool:
    at, frames = 12, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"VP8X" and at + 8 < len(data) and data[at + 8] & 2:
            return False
        frames += kind == b"ANMF"
        at += 8 + size + size % 2
    return frames == 0


def _bmff(data: bytes) -> bool:
    size = int.from_bytes(data[:4], "big")
    brands = {data[8:12], *(data[i : i + 4] for i in range(16, min(size, len(data)), 4))}
    return not brands & {b"avis", b"hevc", b"hevx", b"msf1", b"heis", b"hevm", b"hevs"}


def one_frame(data: bytes) -> bool:
    """Whether a file's container holds one frame alone, by its chunks, blocks or brands; true for other kinds."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:4] == b"GIF8":
        return _gif(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    return _bmff(data) if data[4:8] == b"ftyp" else True


def is_one_frame(content: Column) -> Column:
    return F.pandas_udf(lambda files: pd.Series([None if f is None else one_frame(bytes(f)) for f in files], dtype="object"), "boolean")(content)
