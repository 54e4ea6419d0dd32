"""Shifts between image frames by phase correlation, for whole Arrow batches of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

# Least side of a frame, cells around the peak that don't count as a second, share of cells that is full activity.
LEAST_SIDE, AROUND_PEAK, FULL_ACTIVITY = 4, 2, 0.01
SCHEMA = StructType().add("dx", "double").add("dy", "double").add("confidence", "double").add("valid", "boolean").add("reason", "string")


def _tops(line: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """Offset of a parabola's top from each line's peak, within half a cell; 0 if flat."""
    n, rows = line.shape[1], np.arange(len(line))
    left, mid, right = (line[rows, (peak + d) % n] for d in (-1, 0, 1))
    bend = left - 2 * mid + right
    flat = np.abs(bend) < 1e-12
    return np.where(flat, 0.0, np.clip(0.5 * (left - right) / np.where(flat, 1.0, bend), -0.5, 0.5))


def shifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """dx, dy, confidence of each pair of usable frames (n, height, width)."""
    n, h, w = before.shape
    hann = np.outer(np.hanning(h), np.hanning(w))
    spectra = [np.fft.fft2((f - f.mean(axis=(1, 2), keepdims=True)) * hann) for f in (before, after)]
    cross = spectra[0].conj() * spectra[1]
    response = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    rows = np.arange(n)
    y, x = np.divmod(response.reshape(n, -1).argmax(axis=1), w)
    peak = response[rows, y, x]
    dx, dy = x - np.where(x > w // 2, w, 0) + _tops(response[rows, y], x), y - np.where(y > h // 2, h, 0) + _tops(response[rows, :, x], y)

    def near(size: int, at: np.ndarray) -> np.ndarray:
        away = np.abs(np.arange(size) - at[:, None])
        return np.minimum(away, size - away) <= AROUND_PEAK

    others = np.where(near(h, y)[:, :, None] & near(w, x)[:, None, :], -np.inf, response).max(axis=(1, 2))
    active = np.minimum(*((f != 0).mean(axis=(1, 2)) for f in (before, after)))
    distinct = np.where(peak > 0, (peak - np.maximum(others, 0)) / np.where(peak > 0, peak, 1.0), 0.0)
    return np.stack([dx, dy, np.clip(distinct * np.minimum(active / FULL_ACTIVITY, 1.0), 0.0, 1.0)], axis=1)


def _reason(frame: np.ndarray, h: int, w: int) -> str | None:
    if min(h, w) < LEAST_SIDE:
        return "frame_too_small"
    if not np.isfinite(frame).all():
        return "non_finite_frame"
    return None if frame.any() else "empty_frame"


@pandas_udf(SCHEMA)
def frame_shift(before: pd.Series, after: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Shift from one gray frame (array<double>, row by row) to the next, with a confidence from 0 to 1. Frames that can't
    be compared give 0 and the reason; a null frame is an empty one. Frames of other than height x width cells raise."""
    out = pd.DataFrame({"dx": 0.0, "dy": 0.0, "confidence": 0.0, "valid": False, "reason": "ok"}, index=before.index)
    groups: dict[tuple[int, int], list[int]] = {}
    pairs = {}
    for i, (a, b, h, w) in enumerate(zip(before, after, height, width, strict=True)):
        if a is None or b is None:
            out.iloc[i, 4] = "empty_frame"
            continue
        a, b = np.asarray(a, float), np.asarray(b, float)
        if len(a) != h * w or len(b) != h * w:
            raise ValueError(f"frames of {len(a)} and {len(b)} cells, expected {h} x {w}")
        if reason := _reason(a, h, w) or _reason(b, h, w):
            out.iloc[i, 4] = reason
        else:
            pairs[i] = (a.reshape(h, w), b.reshape(h, w))
            groups.setdefault((h, w), []).append(i)
    for rows in groups.values():
        out.iloc[rows, :3] = shifts(*(np.stack([pairs[i][side] for i in rows]) for side in (0, 1)))
        out.iloc[rows, 3] = True
    return out


# Side of a resampled frame and of a patch, and what is added to a patch's deviation.
FRAME_SIDE, PATCH_SIDE, SLACK = 32, 8, 1e-6


def overlap_weights(n: int, m: int) -> np.ndarray:
    """m x n: the share that each of n cells has of each of m cells laid over the same length."""
    edges = np.arange(m + 1) * (n / m)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(n)
    return np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None) / (n / m)


def patches(frames: np.ndarray, side: int, patch: int) -> np.ndarray:
    """(n, tiles, cells) of gray frames (n, height, width): resampled by area to side x side, cut into tiles of patch x
    patch, each less its mean and by its deviation."""
    n, h, w = frames.shape
    small = overlap_weights(h, side) @ frames @ overlap_weights(w, side).T
    grid = side // patch
    tiles = small.reshape(n, grid, patch, grid, patch).transpose(0, 1, 3, 2, 4).reshape(n, grid * grid, patch * patch)
    return (tiles - tiles.mean(axis=2, keepdims=True)) / (tiles.std(axis=2, keepdims=True) + SLACK)


def frame_patches(side: int = FRAME_SIDE, patch: int = PATCH_SIDE):
    """A function of pixels (array<double>, row by row), height and width: array<array<double>>, a tile's cells each.

    Frames with a value over 1 are divided by 255, and all are clipped to 0..1. A null or empty frame gives null; one of
    other than height x width cells raises. Frames of one size are worked on at once."""
    if side % patch:
        raise ValueError("a patch must divide the side")

    @pandas_udf("array<array<double>>")
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out, groups = [None] * len(pixels), {}
        for i, (p, h, w) in enumerate(zip(pixels, height, width, strict=True)):
            if p is None or not len(p):
                continue
            if len(p) != h * w:
                raise ValueError(f"a frame of {len(p)} cells, expected {h} x {w}")
            groups.setdefault((int(h), int(w)), []).append(i)
        for (h, w), rows in groups.items():
            frames = np.stack([np.asarray(pixels[i], float).reshape(h, w) for i in rows])
            scale = np.where(frames.max(axis=(1, 2), keepdims=True) > 1.0, 255.0, 1.0)
            for i, tiles in zip(rows, patches(np.clip(frames / scale, 0.0, 1.0), side, patch), strict=True):
                out[i] = [list(map(float, t)) for t in tiles]
        return pd.Series(out, dtype=object)

    return run
