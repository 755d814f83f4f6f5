"""Functions opaque to the optimizer, over decoded arrays: perceptual hash, flatness, patch differences.

They take pixels as arrays, so that any decoder can stand before them; none is needed here.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, KEEP = 32, 8
#: The lowest KEEP cosine waves over a side, one a row, each sampled in the middle of its pixels.
_WAVES = np.cos(np.outer(np.arange(KEEP), (np.arange(SIDE) + 0.5) * np.pi / SIDE))


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits: low cosine frequencies of a 32x32 picture above their median (the constant one left out), signed."""
    amount = np.einsum("ay,yx,bx->ab", _WAVES, np.asarray(grey, float), _WAVES, optimize=True).ravel()
    middle = np.median(amount[1:])
    return int.from_bytes(np.packbits(amount > middle).tobytes(), "big", signed=True)


def rotations(grey: np.ndarray) -> list[int]:
    return [perceptual_hash(np.rot90(grey, k)) for k in range(4)]


def flatness(rgb: np.ndarray) -> float:
    """Share of the four commonest colours, at four bits a channel."""
    code = (rgb.reshape(-1, 3).astype(int) >> 4) @ np.array([256, 16, 1])
    counts = np.sort(np.bincount(code))[::-1]
    return float(counts[:4].sum() / max(1, len(code)))


def worst_patch(a: np.ndarray, b: np.ndarray, patch: int = 16) -> float:
    """Largest mean absolute difference among the patches of two grey pictures of one size."""
    d = np.abs(a.astype(float) - b.astype(float))
    n = d.shape[0] // patch
    return float(d[: n * patch, : n * patch].reshape(n, patch, n, patch).mean((1, 3)).max())


def thumbnail(rgb: np.ndarray, longest: int = 256) -> bytes:
    """A PNG of a picture (height, width, 3), its longer side `longest` at most, each pixel the mean of those it stands for."""
    h, w = rgb.shape[:2]
    scale = max(1.0, max(h, w) / longest)
    rows, cols = (np.unique(np.floor(np.arange(max(1, round(n / scale))) * scale).astype(int)) for n in (h, w))
    small = np.add.reduceat(np.add.reduceat(rgb.astype(float), rows, 0), cols, 1)
    counts = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))[None, :]
    pixels = np.rint(small / counts[:, :, None]).astype(np.uint8)
    raw = b"".join(b"\0" + line.tobytes() for line in pixels)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def strip(frames: list[np.ndarray], gap: int = 4) -> np.ndarray:
    """Frames of one height side by side, parted by white."""
    white = np.full((frames[0].shape[0], gap, 3), 255, frames[0].dtype)
    return np.concatenate([x for f in frames for x in (f, white)][:-1], axis=1)


@F.pandas_udf(T.BinaryType())
def thumbnail_udf(rgb: pd.Series, width: pd.Series) -> pd.Series:
    """PNGs of colours given as flat arrays of three values a pixel."""
    return pd.Series([thumbnail(np.asarray(c, np.uint8).reshape(-1, int(w), 3)) for c, w in zip(rgb, width, strict=True)])


@F.pandas_udf(T.LongType())
def perceptual_hash_udf(grey: pd.Series) -> pd.Series:
    """Of 32x32 greys as flat arrays."""
    return grey.map(lambda g: perceptual_hash(np.asarray(g).reshape(SIDE, SIDE)))


@F.pandas_udf(T.DoubleType())
def flatness_udf(rgb: pd.Series) -> pd.Series:
    """Of colours as flat arrays of three values a pixel."""
    return rgb.map(lambda c: flatness(np.asarray(c)))
