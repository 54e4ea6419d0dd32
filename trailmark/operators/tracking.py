"""Motion between frames: by what whole frames weigh, and by consensus of matched points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.sequences import previous

#: Fixed: matches that a frame's texture stands for at full scale, the most of them, and the share that counts as inliers.
TEXTURE_MATCHES, MOST_MATCHES, INLIER_SHARE, FULL_SCALE = 350.0, 120.0, 0.75, 255.0


def total_variation(pixels: Column, width: int) -> Column:
    """Sum of the differences between neighbours along both axes of a gray frame, given row by row."""
    n = F.size(pixels)
    cells = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def steps(i: Column) -> Column:
        here = F.get(pixels, i - 1)
        right = F.when(i % width != 0, F.abs(F.get(pixels, i) - here)).otherwise(0.0)
        below = F.when(i + width <= n, F.abs(F.get(pixels, i - 1 + width) - here)).otherwise(0.0)
        return right + below

    return F.when(n > 0, F.aggregate(cells, F.lit(0.0), lambda acc, i: acc + steps(i))).otherwise(0.0)


def weighted_centre(pixels: Column, width: int) -> tuple[Column, Column]:
    """Mean column and row of a frame's cells, weighted by their values; 0, 0 where these add up to nothing."""
    placed = F.transform(pixels, lambda v, i: F.struct(v.alias("v"), (i % width).alias("x"), F.floor(i / width).alias("y")))
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(placed, zero, lambda acc, c: F.struct((acc["v"] + c["v"]).alias("v"), (acc["x"] + c["v"] * c["x"]).alias("x"), (acc["y"] + c["v"] * c["y"]).alias("y")))
    return tuple(F.when(sums["v"] > 1e-9, sums[a] / sums["v"]).otherwise(0.0) for a in ("x", "y"))


def texture_pairs(frames: DataFrame, keys: list[str], order: str, width: int, pixels: str = "pixels", bucket: float | None = None) -> DataFrame:
    """keys, order, prev_<order>, matches, inliers, inlier_ratio, dx, dy, yaw of each frame and the one before it.

    For frames without features to match: the poorer texture of the two stands for a number of matches, and the shift of
    the weighted centres for the motion. Without texture all is 0. pixels: array<double> from 0 to 255, row by row; null
    frames and empty ones have no texture. Frames become five numbers each before they meet, so no frame is shuffled.
    With a bucket (a length of the order, a number) a key is many tasks; see previous().
    """
    values = F.coalesce(F.col(pixels), F.array().cast("array<double>"))
    x, y = weighted_centre(values, width)
    seen = frames.select(*keys, order, F.struct(F.col(order).alias("at"), total_variation(values, width).alias("edges"), F.size(values).alias("cells"), x.alias("x"), y.alias("y")).alias("_f"))
    both = previous(seen, keys, order, ["_f"], bucket).where("prev is not null")
    now, last = F.col("_f"), F.col("prev._f")
    texture = F.least(now["edges"], last["edges"]) / F.greatest(last["cells"] * FULL_SCALE, F.lit(1.0))
    matches = F.floor(F.least(F.greatest(texture * TEXTURE_MATCHES, F.lit(0.0)), F.lit(MOST_MATCHES))).cast("long")
    out = both.select(*keys, order, last["at"].alias(f"prev_{order}"), matches.alias("matches"), (now["x"] - last["x"]).alias("dx"), (now["y"] - last["y"]).alias("dy"))
    some = F.col("matches") > 0
    inliers = F.when(some, F.greatest(F.floor(F.col("matches") * INLIER_SHARE), F.lit(1))).otherwise(0).cast("long")
    ratio = F.when(some, F.col("inliers") / F.col("matches")).otherwise(0.0)
    out = out.withColumn("inliers", inliers).withColumn("inlier_ratio", ratio)
    return out.select(*keys, order, f"prev_{order}", "matches", "inliers", "inlier_ratio", *[F.when(some, F.col(c)).otherwise(0.0).alias(c) for c in ("dx", "dy")], F.lit(0.0).alias("yaw"))


@dataclass(frozen=True)
class Consensus:
    """Random samples a key, the distance within which a match agrees with one, fewest matches, and the samples' seed."""

    samples: int = 64
    threshold: float = 3.0
    least: int = 8
    seed: int = 0


#: Fixed: a prime below 2^31 and factors of the ranks by which samples are drawn.
PRIME, FACTOR, SHIFT, STEP = 2_147_483_647, 1_103_515_245, 69_621, 48_271
POINTS = ["x0", "y0", "x1", "y1"]


def on_circle(match_id: Column, place: int) -> Column:
    """Where a match lies on a circle of PRIME steps: ids are spread over it, differently for each place. Exact in 64 bits."""
    spread = F.pmod(F.pmod(match_id.cast("long"), F.lit(PRIME)) * (FACTOR + 2 * place), F.lit(PRIME))
    return F.pmod(spread * STEP, F.lit(PRIME))


def cuts_of(place: int, rule: Consensus) -> tuple[list[int], list[int]]:
    """Where the draws begin on the circle, in order, and each draw's place in that order."""
    begins = [-((h * 97 + place * 13 + rule.seed) * SHIFT % PRIME) * STEP % PRIME for h in range(rule.samples)]
    order = sorted(range(rule.samples), key=begins.__getitem__)
    return [begins[h] for h in order], [order.index(h) for h in range(rule.samples)]


def filled(arcs: Column, n: int) -> Column:
    """The points of the first arc at or after each of n arcs, around the circle. arcs: sorted structs arc, p; not empty."""
    last = F.element_at(arcs, -1)["arc"]
    runs = F.transform(arcs, lambda e, i: F.array_repeat(e["p"], e["arc"] - F.when(i > 0, F.get(arcs, i - 1)["arc"]).otherwise(-1)))
    return F.concat(F.flatten(runs), F.array_repeat(F.get(arcs, F.lit(0))["p"], F.lit(n - 1) - last))


def draw_samples(matches: DataFrame, keys: list[str], match_id: str, size: int, rule: Consensus) -> DataFrame:
    """keys, h, s0, s1, ...: for each draw h the matches of least rank, one for each place, as structs.

    A rank is how far a match lies beyond the draw's beginning on a circle (of equals the least id), the same wherever it
    is computed. The beginnings part the circle into arcs, and only an arc's first match can be drawn: a match is one row
    for each place, not for each draw, dealt by key, place and arc, and a key leaves one row an arc."""
    n = rule.samples
    cuts = [cuts_of(k, rule) for k in range(size)]
    begins = F.get(F.array(*[F.array(*[F.lit(c).cast("long") for c in at]) for at, _ in cuts]), F.col("_place"))
    places = F.array(*[F.struct(F.lit(k).alias("_place"), on_circle(F.col("_id"), k).alias("_at")) for k in range(size)])
    each = matches.select(*keys, F.col(match_id).alias("_id"), *POINTS).select("*", F.inline(places))
    # How many beginnings lie at or before the match, by halving.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    before = F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get(begins, done + step - 1) <= F.col("_at"), done + step).otherwise(done))
    each = each.withColumn("_arc", F.pmod(before - 1, F.lit(n)))
    each = each.withColumn("_at", F.pmod(F.col("_at") - F.get(begins, F.col("_arc")), F.lit(PRIME))).repartition(*keys, "_place", "_arc")
    point = F.struct(F.col("_id").alias("id"), *POINTS)
    firsts = each.groupBy(*keys, "_place", "_arc").agg(F.min(F.struct("_at", point.alias("p")))["p"].alias("_p"))
    found = F.struct(F.col("_arc").alias("arc"), F.col("_p").alias("p"))
    arcs = firsts.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("_place") == k, found))).alias(f"_s{k}") for k in range(size)])
    drawn = arcs.select(*keys, *[filled(F.col(f"_s{k}"), n).alias(f"_s{k}") for k in range(size)]).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("h"))
    return drawn.select(*keys, "h", *[F.get(F.col(f"_s{k}"), F.get(F.array(*[F.lit(i) for i in order]), F.col("h"))).alias(f"s{k}") for k, (_, order) in enumerate(cuts)])


def scored(matches: DataFrame, keys: list[str], models: DataFrame, agrees, rule: Consensus) -> DataFrame:
    """keys, h, inliers of the model that most matches agree with (of equals the first draw), for keys that have a model.

    models: keys, h and their numbers. Each match meets its key's models as one array, and is counted where it is."""
    names = [c for c in models.columns if c not in keys]
    lists = models.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("_models"))
    each = matches.join(lists, keys).select(*keys, *POINTS, F.explode("_models").alias("_m")).where(agrees(lambda n: F.col("_m")[n], rule.threshold))
    counts = each.groupBy(*keys, *[F.col("_m")[c].alias(c) for c in names]).agg(F.count("*").alias("inliers"))
    order = F.col("inliers") * rule.samples - F.col("h")  # numbers only, so that aggregation sorts nothing
    top = counts.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in names], F.max("inliers").alias("inliers"))
    return top.select(*keys, F.struct(*names).alias("model"), "inliers")


def _similar(m, threshold: float) -> Column:
    dx = m("a") * F.col("x0") - m("b") * F.col("y0") + m("tx") - F.col("x1")
    dy = m("b") * F.col("x0") + m("a") * F.col("y0") + m("ty") - F.col("y1")
    return dx * dx + dy * dy <= threshold * threshold


def similarity_of(x: list[Column]) -> tuple[Column, Column]:
    """a, b of the turn and scale that takes one difference of points to another: [dx0, dy0, dx1, dy1]."""
    size = x[0] * x[0] + x[1] * x[1]
    return (x[0] * x[2] + x[1] * x[3]) / size, (x[0] * x[3] - x[1] * x[2]) / size


def two_view(matches: DataFrame, keys: list[str], match_id: str, rule: Consensus = Consensus()) -> DataFrame:
    """keys, matches, inliers, inlier_ratio, tx, ty, scale, yaw: the turn, scale and shift that takes x0, y0 to x1, y1.

    Each draw of two matches is a hypothesis; the one that most matches agree with is fitted again, by least squares, to
    those that agree. Fewer matches than `least`: all 0. No hypothesis (all draws fall on one point): the median shift,
    without inliers or yaw. Matches with a null anywhere don't count; a key without any has no row. Everything is
    aggregation by key; a key's work is its matches times the draws, wherever its rows are.
    """
    whole = matches.where(" and ".join(f"{c} is not null" for c in [match_id, *POINTS])).select(*keys, match_id, *POINTS)
    drawn = draw_samples(whole, keys, match_id, 2, rule)
    way = [F.col(f"s1.{c}") - F.col(f"s0.{c}") for c in POINTS]
    a, b = similarity_of(way)
    models = drawn.where((way[0] != 0) | (way[1] != 0)).select("*", a.alias("a"), b.alias("b"))
    models = models.select(*keys, "h", "a", "b", (F.col("s0.x1") - F.col("a") * F.col("s0.x0") + F.col("b") * F.col("s0.y0")).alias("tx"), (F.col("s0.y1") - F.col("b") * F.col("s0.x0") - F.col("a") * F.col("s0.y0")).alias("ty"))
    best = scored(whole, keys, models, _similar, rule)
    agreed = whole.join(best, keys, "left")
    inside = F.coalesce(_similar(lambda n: F.col("model")[n], rule.threshold), F.lit(False))
    n = F.count_if("_in")
    mean = {c: F.sum(F.when(F.col("_in"), F.col(c))) / n for c in POINTS}
    products = {p + q: F.sum(F.when(F.col("_in"), F.col(p) * F.col(q))) / n - mean[p] * mean[q] for p, q in (("x0", "x0"), ("y0", "y0"), ("x0", "x1"), ("y0", "y1"), ("x0", "y1"), ("y0", "x1"))}
    model = {c: F.col("model")[c].alias(f"_m{c}") for c in ("h", "a", "b")}
    sums = agreed.select(*keys, *POINTS, inside.alias("_in"), *model.values()).groupBy(*keys).agg(
        F.count("*").alias("matches"), n.alias("inliers"), *[v.alias(f"_{k}") for k, v in (mean | products).items()], F.median(F.col("x1") - F.col("x0")).alias("_fx"), F.median(F.col("y1") - F.col("y0")).alias("_fy"), *[F.first(f"_m{c}").alias(f"_m{c}") for c in model],
    )
    spread = F.col("_x0x0") + F.col("_y0y0")
    fit_a, fit_b = F.when(spread > 0, (F.col("_x0x1") + F.col("_y0y1")) / spread), F.when(spread > 0, (F.col("_x0y1") - F.col("_y0x1")) / spread)
    fitted = sums.withColumn("_a", F.coalesce(fit_a, F.col("_ma"))).withColumn("_b", F.coalesce(fit_b, F.col("_mb")))
    tx, ty = F.col("_x1") - F.col("_a") * F.col("_x0") + F.col("_b") * F.col("_y0"), F.col("_y1") - F.col("_b") * F.col("_x0") - F.col("_a") * F.col("_y0")
    enough, found = F.col("matches") >= rule.least, F.col("_mh").isNotNull()

    def pick(value: Column, without: Column | float) -> Column:
        return F.when(~enough, 0.0).when(found, value).otherwise(without)

    made = {"tx": pick(tx, F.col("_fx")), "ty": pick(ty, F.col("_fy")), "scale": pick(F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")), 0.0), "yaw": pick(F.atan2("_b", "_a"), 0.0)}
    inliers = F.when(enough & found, F.col("inliers")).otherwise(0)
    return fitted.select(*keys, "matches", inliers.cast("long").alias("inliers"), (inliers / F.col("matches")).alias("inlier_ratio"), *[v.alias(k) for k, v in made.items()])


# --- Homographies ---

H = [f"h{i}" for i in range(9)]
#: Pairs of the nine columns of a match's two equations: what their sums of products are named by.
CELLS = [(i, j) for i in range(9) for j in range(i, 9)]


def _scaled_to_one(h: np.ndarray) -> np.ndarray:
    """Matrices (n, 9) with 1 as their last number where that isn't 0."""
    last = h[:, 8:]
    return np.divide(h, last, out=h.copy(), where=np.abs(last) > 1e-12)


def null_vectors(normal: np.ndarray) -> np.ndarray:
    """The direction in which each symmetric matrix (n, 9, 9) is least."""
    return np.linalg.eigh(normal)[1][:, :, 0]


def _moved_back(h: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Homographies of centred and scaled points as those of the points. before, after: (n, 3) of centre and scale."""
    n = len(h)
    t0, t1 = np.zeros((n, 3, 3)), np.zeros((n, 3, 3))
    for t, (cx, cy, s) in ((t0, before.T), (t1, after.T)):
        t[:, 0, 0], t[:, 1, 1], t[:, 2, 2], t[:, 0, 2], t[:, 1, 2] = s, s, 1, -s * cx, -s * cy
    return (np.linalg.inv(t1) @ h.reshape(n, 3, 3) @ t0).reshape(n, 9)


def homographies_of_samples(points: np.ndarray) -> np.ndarray:
    """Homographies (n, 9) of four point pairs each (n, 4, 4: x0, y0, x1, y1); not finite where the points allow none."""
    n = len(points)
    x, y, u, v = (points[:, :, k] for k in range(4))
    rows = np.zeros((n, 8, 9))
    rows[:, 0::2, 0], rows[:, 0::2, 1], rows[:, 0::2, 2] = x, y, 1
    rows[:, 1::2, 3], rows[:, 1::2, 4], rows[:, 1::2, 5] = x, y, 1
    for k, w in ((0, u), (1, v)):
        rows[:, k::2, 6], rows[:, k::2, 7], rows[:, k::2, 8] = -w * x, -w * y, -w
    size = np.abs(rows).max(axis=(1, 2), keepdims=True)
    _, d, vt = np.linalg.svd(rows / np.maximum(size, 1e-300), full_matrices=True)
    out = _scaled_to_one(vt[:, 8])
    out[d[:, 7] <= 1e-9 * d[:, 0]] = np.nan  # repeated points, or three on a line
    return out


def _projects(m, threshold: float) -> Column:
    w = m("h6") * F.col("x0") + m("h7") * F.col("y0") + m("h8")
    dx = (m("h0") * F.col("x0") + m("h1") * F.col("y0") + m("h2")) / w - F.col("x1")
    dy = (m("h3") * F.col("x0") + m("h4") * F.col("y0") + m("h5")) / w - F.col("y1")
    return (F.abs(w) > 1e-12) & (dx * dx + dy * dy <= threshold * threshold)


def direct_transform(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, h0..h8 (h8 is 1, or 0 where it is): the homography that takes x0, y0 to x1, y1 best, algebraically.

    Points are centred and scaled by their key's mean and spread; the 45 different sums of products of the two equations
    of each match are one aggregation, and a task finds the null vector of one 9 x 9 matrix for each key. Fewer than four
    matches, or points that allow none (all at one place): nulls.
    """
    spread = {c: (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")) for c in POINTS}
    stats = matches.groupBy(*keys).agg(F.count("*").alias("n"), *[x for v in spread.values() for x in v])
    scale = {k: F.sqrt(2.0 / (F.col(f"v_x{k}") + F.col(f"v_y{k}"))) for k in (0, 1)}
    known = stats.where("n >= 4 and v_x0 + v_y0 > 0 and v_x1 + v_y1 > 0").select(*keys, "n", *[f"m_{c}" for c in POINTS], *[v.alias(f"s{k}") for k, v in scale.items()])
    joined = matches.select(*keys, *POINTS).join(known, keys)
    x, y, u, v = ((F.col(c) - F.col(f"m_{c}")) * F.col(f"s{c[1]}") for c in POINTS)
    named = joined.select(*keys, "n", *[f"m_{c}" for c in POINTS], "s0", "s1", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    x, y, u, v, one, none = F.col("x"), F.col("y"), F.col("u"), F.col("v"), F.lit(1.0), F.lit(0.0)
    first, second = [x, y, one, none, none, none, -u * x, -u * y, -u], [none, none, none, x, y, one, -v * x, -v * y, -v]
    cells = [F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"c{k}") for k, (i, j) in enumerate(CELLS)]
    shared = ["n", *[f"m_{c}" for c in POINTS], "s0", "s1"]
    sums = named.groupBy(*keys).agg(*[F.first(c).alias(c) for c in shared], *cells)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            normal = np.zeros((len(rows), 9, 9))
            for k, (i, j) in enumerate(CELLS):
                normal[:, i, j] = normal[:, j, i] = rows[f"c{k}"]
            h = _scaled_to_one(_moved_back(null_vectors(normal), rows[["m_x0", "m_y0", "s0"]].to_numpy(), rows[["m_x1", "m_y1", "s1"]].to_numpy())) if len(rows) else np.zeros((0, 9))
            yield pd.concat([rows[keys].reset_index(drop=True), pd.DataFrame(h, columns=H)], axis=1)

    types = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in keys)
    return stats.select(*keys, "n").join(sums.mapInPandas(solve, f"{types}, " + ", ".join(f"{h} double" for h in H)), keys, "left")


def robust_homography(matches: DataFrame, keys: list[str], match_id: str, rule: Consensus = Consensus(samples=128, threshold=5.0, least=4)) -> DataFrame:
    """keys, matches, inliers, h0..h8: the homography that most matches agree with (within `threshold` of where it puts
    them), fitted again to those.

    Each draw of four matches is a hypothesis. Fewer matches than `least` (four at least), or none that any draw allows:
    nulls and no inliers. Matches with a null anywhere don't count; a key without any has no row.
    """
    whole = matches.where(" and ".join(f"{c} is not null" for c in [match_id, *POINTS])).select(*keys, match_id, *[F.col(c).cast("double").alias(c) for c in POINTS])
    counts = whole.groupBy(*keys).agg(F.count("*").alias("matches"))
    enough = whole.join(counts.where(F.col("matches") >= max(4, rule.least)).select(*keys), keys, "left_semi")
    drawn = draw_samples(enough, keys, match_id, 4, rule)
    flat = drawn.select(*keys, "h", *[F.col(f"s{k}.{c}").alias(f"{c}_{k}") for k in range(4) for c in POINTS])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            points = rows[[f"{c}_{k}" for k in range(4) for c in POINTS]].to_numpy(float).reshape(-1, 4, 4)
            h = homographies_of_samples(points)
            out = pd.concat([rows[[*keys, "h"]].reset_index(drop=True), pd.DataFrame(h, columns=H)], axis=1)
            yield out[np.isfinite(h).all(axis=1)]

    types = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in keys)
    models = flat.mapInPandas(solve, f"{types}, h int, " + ", ".join(f"{h} double" for h in H))
    best = scored(enough, keys, models, _projects, rule)
    agreed = enough.join(best, keys).where(_projects(lambda n: F.col("model")[n], rule.threshold))
    again = direct_transform(agreed.select(*keys, *POINTS), keys).drop("n")
    out = counts.join(best.select(*keys, "inliers", "model"), keys, "left").join(again, keys, "left")
    # With no more than a sample's matches the fit is the sample's own.
    return out.select(*keys, "matches", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"), *[F.coalesce(F.col(h), F.col("model")[h]).alias(h) for h in H])
