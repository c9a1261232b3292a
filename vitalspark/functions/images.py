"""Pixels of PNG images in NumPy, and the Arrow functions that summarise frames without keeping their pixels.

Row filters are undone along diagonals: a pixel needs its left, upper and upper left neighbours only,
so all pixels of a diagonal are done at once, whatever filters their rows have. Interlaced images and
JPEG are told apart as unsupported.
"""

from __future__ import annotations

import base64
import binascii
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first bytes of the formats; channels by colour type; names of colour types.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
#: A channel value from which it is bright, and up to which it is dark.
BRIGHT, DARK = 250, 10
#: Pixels of the largest image that is decoded, so that a small body can't fill a worker's memory.
MOST_PIXELS = 1 << 26


class Unsupported(ValueError):
    """An image of a kind that isn't decoded."""


def payload(url: str | None) -> bytes:
    """The bytes of an image data URL in base64."""
    if url is None:
        raise ValueError("no image")
    head, comma, body = url.partition(",")
    if not comma:
        raise ValueError("no comma in the data URL")
    if not head.startswith("data:image/") or ";base64" not in head:
        raise ValueError("not an image in base64")
    if not body:
        raise ValueError("empty payload")
    try:
        return base64.b64decode(body, validate=True)
    except binascii.Error:
        raise ValueError("broken base64") from None


def unfiltered(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Undo the row filters; data: rows, units, bytes of a unit."""
    h, w, size = data.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    out = np.zeros((h + 1, w + 1, size), dtype=np.int16)
    if kinds.max(initial=0) <= 2:  # none, left and up go by whole rows
        for y in range(h):
            row = np.cumsum(data[y], axis=0, dtype=np.int64) if kinds[y] == 1 else data[y].astype(np.int64) + (out[y, 1:] if kinds[y] == 2 else 0)
            out[y + 1, 1:] = row % 256
        return out[1:, 1:].astype(np.uint8)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        base = left + up - corner
        a, b, c = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        out[y + 1, x + 1] = (data[y, x].astype(np.int16) + guess) % 256
    return out[1:, 1:].astype(np.uint8)


def decode_png(body: bytes) -> tuple[np.ndarray, str]:
    """Pixels (height, width, 3) and the mode of a PNG: grey and palettes become RGB, alpha is left out, 16 bits keep their upper byte."""
    if not body.startswith(PNG):
        raise Unsupported("JPEG" if body.startswith(JPEG) else "unknown format")
    at, data, palette, head = len(PNG), [], None, None
    while at + 12 <= len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        part = body[at + 8 : at + 8 + size]
        if len(part) < size or at + 12 + size > len(body) or struct.unpack(">I", body[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("broken chunk")
        at += 12 + size
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("broken header")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(part)
        elif kind == b"IEND":
            break
    if head is None or not data:
        raise ValueError("no image data")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in CHANNELS or bits not in (1, 2, 4, 8, 16) or not width or not height:
        raise ValueError("broken header")
    if interlaced:
        raise Unsupported("interlaced")
    if width * height > MOST_PIXELS:
        raise Unsupported("too many pixels")
    channels = CHANNELS[colour]
    stride = (width * channels * bits + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), height * (stride + 1))
    except zlib.error:
        raise ValueError("broken image data") from None
    if len(raw) != height * (stride + 1):
        raise ValueError("image data too short")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, stride + 1)
    unit = max(1, channels * bits // 8)
    rows = unfiltered(lines[:, 0], lines[:, 1:].reshape(height, stride // unit, unit)).reshape(height, stride)
    if bits == 16:
        values = rows.reshape(height, width, channels, 2)[..., 0]
    elif bits == 8:
        values = rows.reshape(height, width, channels)
    else:
        split = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        values = (split @ (1 << np.arange(bits - 1, -1, -1)))[:, : width * channels].reshape(height, width, channels)
        if colour != 3:
            values = values * (255 // ((1 << bits) - 1))
    if colour == 3:
        if palette is None or values.max() >= len(palette):
            raise ValueError("no such colour in the palette")
        return palette[values[..., 0]], MODES[colour]
    values = values.astype(np.uint8)
    return (values[..., :3] if colour in (2, 6) else np.repeat(values[..., :1], 3, axis=2)), MODES[colour]


def encode_png(pixels: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """A PNG of pixels (height, width, 1 to 4 channels, bytes), with the row filters asked for: for synthetic frames."""
    h, w, channels = pixels.shape
    kinds = np.zeros(h, dtype=np.uint8) if kinds is None else kinds
    x = np.zeros((h + 1, w + 1, channels), dtype=np.int16)
    x[1:, 1:] = pixels
    left, up, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    base = left + up - corner
    a, b, c = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
    guesses = [np.zeros_like(left), left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))]
    rows = np.stack([(pixels[y] - guesses[kinds[y]][y]) % 256 for y in range(h)]).astype(np.uint8)
    lines = np.concatenate((kinds.astype(np.uint8)[:, None], rows.reshape(h, -1)), axis=1)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    colour = {n: k for k, n in CHANNELS.items() if k != 3}[channels]
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


COLOURS = "struct<r:double,g:double,b:double>"
FRAME = f"status string, message string, width int, height int, channels int, mode string, encoded_size_bytes int, mean_rgb {COLOURS}, std_rgb {COLOURS}, min_rgb {COLOURS}, max_rgb {COLOURS}"
REGION = f"region string, pixels bigint, mean_rgb {COLOURS}, std_rgb {COLOURS}, min_rgb {COLOURS}, max_rgb {COLOURS}, saturated double, red_saturated double, green_saturated double, dark double"
BOX = "array<struct<region:string,x_min:int,x_max:int,y_min:int,y_max:int>>"


def _colours(values: np.ndarray) -> dict[str, float]:
    return dict(zip("rgb", map(float, values), strict=True))


def summary(pixels: np.ndarray) -> dict[str, dict[str, float]]:
    """Mean, deviation, least and most of each channel."""
    flat = pixels.reshape(-1, 3).astype(float)
    return {f"{name}_rgb": _colours(f(flat, axis=0)) for name, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max))}


def region_summary(pixels: np.ndarray, box: dict) -> dict:
    """The same of the pixels inside a box, with the shares of pixels that are bright or dark; without pixels all but the name is null."""
    edges = [box[k] for k in ("y_min", "y_max", "x_min", "x_max")]
    if any(e is None or e != e for e in edges):  # pandas has NaN for a null among numbers
        return {"region": box["region"], "pixels": 0}
    y0, y1, x0, x1 = (max(0, int(e)) for e in edges)
    part = pixels[y0:y1, x0:x1].reshape(-1, 3)
    if not part.size:
        return {"region": box["region"], "pixels": 0}
    bright, dark = part >= BRIGHT, part <= DARK
    shares = {"saturated": bright.any(axis=1), "red_saturated": bright[:, 0], "green_saturated": bright[:, 1], "dark": dark.any(axis=1)}
    return {"region": box["region"], "pixels": len(part), **summary(part), **{k: float(v.mean()) for k, v in shares.items()}}


def _decoded(url: str | None) -> tuple[np.ndarray | None, dict]:
    try:
        body = payload(url)
        pixels, mode = decode_png(body)
    except Unsupported as error:
        return None, {"status": "unsupported", "message": str(error)}
    except ValueError as error:
        return None, {"status": "error", "message": str(error)}
    return pixels, {"status": "received", "message": None, "width": pixels.shape[1], "height": pixels.shape[0], "channels": 3, "mode": mode, "encoded_size_bytes": len(body)}


def frame_summary(url: Column) -> Column:
    """A struct FRAME of an image data URL; status is received, unsupported or error, with a message."""

    @F.pandas_udf(FRAME)
    def run(urls: pd.Series) -> pd.DataFrame:
        names = [c.strip().split(" ")[0] for c in FRAME.replace(COLOURS, "x").split(",")]
        made = []
        for url_ in urls:
            pixels, told = _decoded(url_)
            made.append(told if pixels is None else told | summary(pixels))
        return pd.DataFrame({n: pd.Series([m.get(n) for m in made], dtype=object) for n in names})

    return run(url)


def frame_regions(url: Column, boxes: Column) -> Column:
    """Status and message of an image data URL and a struct REGION for each of its boxes (BOX), from the pixels inside; no pixel leaves the worker."""

    @F.pandas_udf(f"status string, message string, regions array<struct<{', '.join(f'{a}:{b}' for a, b in (c.split(' ') for c in REGION.split(', ')))}>>")
    def run(urls: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        made = []
        for url_, boxes_ in zip(urls, wanted, strict=True):
            pixels, told = _decoded(url_)
            rows = None if pixels is None else [region_summary(pixels, b) for b in (boxes_ if boxes_ is not None else [])]
            made.append((told["status"], told["message"], rows))
        names = [c.split(" ")[0] for c in REGION.split(", ")]
        full = [None if rows is None else [{n: r.get(n) for n in names} for r in rows] for _, _, rows in made]
        return pd.DataFrame({"status": [m[0] for m in made], "message": [m[1] for m in made], "regions": pd.Series(full, dtype=object)})

    return run(url, boxes.cast(BOX))


def painted(values: Column, height: int, width: int, paint: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Data URLs of synthetic frames: `paint` makes pixels (height, width, 3) of a row's numbers; row filters go round."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        kinds = (np.arange(height) % 5).astype(np.uint8)
        return pd.Series([None if r is None else "data:image/png;base64," + base64.b64encode(encode_png(paint(np.asarray(r, dtype=float)), kinds)).decode() for r in rows])

    return run(values)
