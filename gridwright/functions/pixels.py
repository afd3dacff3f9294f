"""Page images in NumPy: PNG files read and written, resampled and cut into the tiles of a grid."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed values of the format: its first bytes, and samples a pixel by colour type
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIDE = 448  # pixels of a tile's side


def unfiltered(raw: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Rows of bytes (height, pixels, bytes a pixel) as they were before each row's filter.

    A byte depends on its neighbours to the left, above and above left, so all bytes on a diagonal are independent: a
    step for each diagonal, whatever filters the rows have.
    """
    height, width, depth = raw.shape
    out = np.zeros((height + 1, width + 1, depth), np.int32)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, kind = d - r, filters[r][:, None]
        left, above, corner = out[r + 1, x], out[r, x + 1], out[r, x]
        guess = left + above - corner
        off = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        nearest = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], above, corner))
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, nearest], 0)
        out[r + 1, x + 1] = (raw[r, x] + add) & 255
    return out[1:, 1:].astype(np.uint8)


def decode(png: bytes) -> np.ndarray:
    """The pixels of a PNG file (height, width, red green blue) as bytes; alpha is left out. ValueError for what is no
    PNG, is cut off, or is interlaced.
    """
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        at += size + 12
        if len(body) < size:
            raise ValueError("a PNG file that is cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[6] or head[3] not in SAMPLES:
        raise ValueError("a PNG file without a header, or interlaced")
    width, height, bits, colour = head[:4]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG data: {e}") from e
    wide = (width * SAMPLES[colour] * bits + 7) // 8
    if len(rows) != height * (wide + 1):
        raise ValueError(f"{len(rows)} bytes of pixels instead of {height * (wide + 1)}")
    rows = rows.reshape(height, wide + 1)
    if (rows[:, 0] > 4).any():
        raise ValueError("an unknown filter")
    depth = max(1, SAMPLES[colour] * bits // 8)
    flat = unfiltered(rows[:, 1:].reshape(height, wide // depth, depth).astype(np.int32), rows[:, 0]).reshape(height, wide)
    if bits == 16:
        flat = flat[:, ::2]
    elif bits < 8:
        places = np.arange(8 // bits - 1, -1, -1) * bits
        flat = ((flat[:, :, None] >> places) & ((1 << bits) - 1)).reshape(height, -1)[:, : width * SAMPLES[colour]]
        flat = flat if colour == 3 else flat * (255 // ((1 << bits) - 1))
    pixels = flat.reshape(height, width, SAMPLES[colour])
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ValueError("a colour that isn't in the palette")
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2).astype(np.uint8) if colour in (0, 4) else pixels[:, :, :3].astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """A PNG file of pixels (height, width, 3) of bytes, each row as its difference from the one above."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, width * 3 + 1), np.uint8)
    rows[:, 0] = 2
    flat = pixels.reshape(height, -1).astype(np.int16)
    rows[:, 1:] = np.diff(flat, axis=0, prepend=np.zeros((1, width * 3), np.int16)) & 255

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def grid(width: int, height: int, most: int) -> tuple[int, int]:
    """Columns and rows of up to `most` tiles: the ratio nearest the image's, then fewest tiles, then fewest columns."""
    pairs = [(n, c) for n in range(1, most + 1) for c in range(1, n + 1) if n % c == 0]
    n, columns = min(pairs, key=lambda p: (abs(p[1] / (p[0] // p[1]) - width / height), p))
    return columns, n // columns


@lru_cache(256)
def weights(old: int, new: int) -> np.ndarray:
    """A matrix (new, old): each new pixel as a mean of old ones, linear between their middles; where the image shrinks,
    over as much wider a range.
    """
    scale = max(1.0, old / new)
    middle = (np.arange(new) + 0.5) * old / new - 0.5
    near = np.maximum(0, 1 - abs(np.arange(old)[None, :] - middle[:, None]) / scale)
    return near / near.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels (rows, columns, channels) at another size, as floats."""
    rows = np.tensordot(weights(pixels.shape[0], height), pixels.astype(np.float64), axes=(1, 0))
    return np.moveaxis(np.tensordot(weights(pixels.shape[1], width), rows, axes=(1, 1)), 0, 1)


def tiles(pixels: np.ndarray, most: int, side: int = SIDE) -> tuple[int, int, np.ndarray]:
    """Columns, rows, and the tiles (number, side, side, channels), a row of them after the other."""
    columns, rows = grid(pixels.shape[1], pixels.shape[0], most)
    whole = resized(pixels, columns * side, rows * side)
    cut = whole.reshape(rows, side, columns, side, -1).swapaxes(1, 2)
    return columns, rows, cut.reshape(rows * columns, side, side, -1)
