"""Column expressions for health, confidence and acceptance of measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: health labels by severity.
SEVERITY = {"OK": 0, "DEGRADED": 1, "LOST": 2, "INVALID": 3}


def health_from_confidence(confidence: Column, ok: float = 0.55, degraded: float = 0.15) -> Column:
    """OK, DEGRADED or LOST by thresholds that are part of the better state; null for null and NaN."""
    known = confidence.isNotNull() & ~F.isnan(confidence)
    return F.when(known & (confidence >= ok), "OK").when(known & (confidence >= degraded), "DEGRADED").when(known, "LOST")


def severity(health: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv])[health]


def worse(a: Column, b: Column) -> Column:
    """The more severe of two labels."""
    return F.when(severity(a) >= severity(b), a).otherwise(b)


def multiplier(health: Column, degraded: float = 0.45) -> Column:
    """1 for OK, less for DEGRADED, 0 for failed states."""
    return F.when(health == "OK", 1.0).when(health == "DEGRADED", degraded).otherwise(0.0)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def in_frame(x: Column, y: Column, width: int, height: int) -> Column:
    """Whether a place is a cell of a frame."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def into_frame(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """The cell of a frame that is nearest to a place."""
    return F.least(F.greatest(x, F.lit(0)), F.lit(width - 1)), F.least(F.greatest(y, F.lit(0)), F.lit(height - 1))


def polarity_bit(p: Column) -> Column:
    """1 for a rising event, else 0, whatever stands for them."""
    return F.when(p > 0, 1).otherwise(0)


def position_sigma(confidence: Column, least: float = 0.05, spread: float = 5.0) -> Column:
    """Standard deviation of a position by confidence."""
    return least + (1 - clip(confidence)) * spread


# Fixed: the chi-square limit of three dimensions that the last gate compares with.
CHI_SQUARE = 16.27


def gate_reason(health: Column, confidence: Column, age: Column, jump: Column, dt: Column, min_confidence: float = 0.15, max_age: float = 0.25, max_speed: float = 60.0, d2: Column | None = None, most: float = CHI_SQUARE) -> Column:
    """The first gate that a measurement fails: health, confidence, timestamp, speed, then, with d2, the squared
    Mahalanobis distance of its innovation; null if it passes all."""
    found = (
        F.when(health.isin("LOST", "INVALID"), "health_gate").when(confidence < min_confidence, "confidence_gate").when(F.abs(age) > max_age, "timestamp_gate")
        .when(jump / F.greatest(dt, F.lit(1e-3)) > max_speed, "motion_sanity_gate")
    )
    return found if d2 is None else found.when(d2 > most, "mahalanobis_gate")


def mahalanobis_squared(e: list[Column], s: list[list[Column]]) -> Column:
    """e' S^-1 e for three components and a symmetric matrix, by the adjugate."""
    (a, b, c), (_, d, f), (_, _, g) = s
    det = a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c)
    adj = [[d * g - f * f, c * f - b * g, b * f - c * d], [c * f - b * g, a * g - c * c, b * c - a * f], [b * f - c * d, b * c - a * f, a * d - b * b]]
    return sum((e[i] * adj[i][j] * e[j] for i in range(3) for j in range(3)), F.lit(0.0)) / det


def trust(age: Column, tau: float = 1.0, ok: float = 0.5, lost: float = 5.0) -> tuple[Column, Column]:
    """Confidence and health by the age of the last accepted update."""
    return F.exp(-age / tau), F.when(age <= ok, "OK").when(age <= lost, "DEGRADED").otherwise("LOST")


def match_confidence(inliers: Column, matches: Column, least: int = 12, share: float = 0.10, full: float = 50.0) -> Column:
    """0 for too few inliers or too small a share of the matches; otherwise inliers / full up to 1."""
    return F.when((matches <= 0) | (inliers < least) | (inliers / matches < share), 0.0).otherwise(F.least(F.lit(1.0), inliers / full))


def pair_confidence(matches: Column, inlier_ratio: Column, keypoints: Column) -> Column:
    """Weighted share of matches, inliers and keypoints of a frame pair."""
    return 0.45 * F.least(matches / 80.0, F.lit(1.0)) + 0.40 * inlier_ratio + 0.15 * F.least(keypoints / 120.0, F.lit(1.0))


def rotation_problem(m: list[Column], tolerance: float = 1e-4) -> Column:
    """Why nine numbers (by rows) are no rotation: not_finite, determinant or not_orthonormal; null for a rotation."""
    finite = ~(sum((F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), 1).otherwise(0) for x in m), F.lit(0)) > 0)
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    off = F.greatest(*[F.abs(sum((m[3 * k + i] * m[3 * k + j] for k in range(3)), F.lit(0.0)) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)])
    return F.when(~finite, "not_finite").when(F.abs(det - 1) > tolerance, "determinant").when(off > tolerance, "not_orthonormal")
