"""Differential packing of fields in numpy: parameters, encoding with feedback, decoding of whole fields and windows."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np


class Packed(NamedTuple):
    payload: bytes
    exponent: int
    precision: float
    initial: float
    checksum: int


def checksum(payload: bytes) -> int:
    """0 for all zeros, else the sum of bytes folded into 1 to 255."""
    total = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))
    return (total - 1) % 255 + 1 if total else 0


def parameters(field: np.ndarray) -> tuple[int, float]:
    """Exponent and precision from the largest step along a row or down the first column."""
    step = 0.0
    if field.shape[1] > 1:
        step = float(np.abs(np.diff(field, axis=1)).max())
    if field.shape[0] > 1:
        step = max(step, float(np.abs(np.diff(field[:, 0])).max()))
    power = math.log(step) / math.log(2.0) if step > 0 else 0.0
    exponent = int(power)
    if power >= 0 or power == exponent:
        exponent += 1
    return exponent, 2.0**exponent / 254.0


def pack(field: np.ndarray) -> Packed:
    """Encode a (ny, nx) field. Each byte holds the step from the value that a decoder has so far, so errors do not add up.

    Once the first column is known rows do not depend on each other: the loop runs over columns, all rows at a time.
    """
    values = np.asarray(field, np.float32).astype(np.float64)
    exponent, precision = parameters(values)
    values = np.where(np.abs(values) < precision, 0.0, values)
    ny, nx = values.shape
    scale = 2.0 ** (7 - exponent)
    out = np.empty((ny, nx), np.uint8)
    initial = now = float(values[0, 0])
    first = np.empty(ny)
    for y in range(ny):
        code = int((values[y, 0] - now) * scale + 127.5) & 255
        out[y, 0] = code
        now += (code - 127) / scale
        first[y] = now
    now = first
    for x in range(1, nx):
        code = np.trunc((values[:, x] - now) * scale + 127.5).astype(np.int64) & 255
        out[:, x] = code
        now = now + (code - 127) / scale
    payload = out.tobytes()
    return Packed(payload, exponent, precision, initial, checksum(payload))


def unpack(payload: bytes, nx: int, ny: int, precision: float, exponent: int, initial: float, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Decode a field, or its window (x_start, x_stop, y_start, y_stop), as float32.

    A window needs the first column down to its last row and its rows up to its last column, no more.
    """
    if len(payload) != nx * ny:
        raise ValueError(f"a payload of {len(payload)} bytes for {nx} x {ny} cells")
    x0, x1, y0, y1 = window or (0, nx, 0, ny)
    if not (0 <= x0 < x1 <= nx and 0 <= y0 < y1 <= ny):
        raise ValueError(f"window {window} is outside the grid")
    raw = np.frombuffer(payload, np.uint8).reshape(ny, nx)
    scale = 2.0 ** (7 - exponent)
    first = np.cumsum((raw[:y1, 0].astype(np.float64) - 127) / scale) + initial
    steps = (raw[y0:y1, :x1].astype(np.float64) - 127) / scale
    steps[:, 0] = first[y0:]
    out = np.cumsum(steps, axis=1)[:, x0:]
    out[np.abs(out) < precision] = 0.0
    return out.astype(np.float32)


def residual(field: np.ndarray, parent: Packed) -> Packed:
    """The difference record of a field: what its packed form has lost, packed again."""
    ny, nx = field.shape
    return pack(np.asarray(field, np.float32) - unpack(parent.payload, nx, ny, parent.precision, parent.exponent, parent.initial))
