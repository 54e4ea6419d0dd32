"""Windows and frames of event streams; all keep the given key columns apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packets(events: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys, win, n: tumbling windows from each key's first event, the last one closed, empty ones kept."""
    span = events.groupBy(*keys).agg(F.min("t").alias("t0"), F.greatest(F.ceil((F.max("t") - F.min("t")) / width), F.lit(1)).alias("many"))
    numbered = events.join(span, keys).withColumn("win", F.least(F.floor((F.col("t") - F.col("t0")) / width), F.col("many") - 1))
    counts = numbered.groupBy(*keys, "win").agg(F.count("*").alias("n"))
    every = span.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("win"))
    return every.join(counts, [*keys, "win"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def render_bins(events: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys, bin, red, blue: whether a bin from time 0 on has positive and other events; empty bins kept."""
    hit = events.groupBy(*keys, F.floor(F.col("t") / width).alias("bin")).agg(F.bool_or(F.col("p") > 0).alias("red"), F.bool_or(F.col("p") <= 0).alias("blue"))
    every = hit.groupBy(*keys).agg(F.max("bin").alias("n")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("bin"))
    return every.join(hit, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("red", F.lit(False)).alias("red"), F.coalesce("blue", F.lit(False)).alias("blue"))


def count_frame(events: DataFrame, keys: list[str], pixel: list[str]) -> DataFrame:
    """Positive and other events of each pixel that fired."""
    return events.groupBy(*keys, *pixel).agg(F.count_if(F.col("p") > 0).alias("n_pos"), F.count_if(F.col("p") <= 0).alias("n_neg"))


def time_surface(events: DataFrame, keys: list[str], pixel: list[str], tau: float) -> DataFrame:
    """exp(-(last time of the key - last time of the pixel) / tau)."""
    last = events.groupBy(*keys, *pixel).agg(F.max("t").alias("t"))
    return last.withColumn("surface", F.exp(-(F.max("t").over(Window.partitionBy(*keys)) - F.col("t")) / tau))


def edges(events: DataFrame, keys: list[str], pixel: list[str]) -> DataFrame:
    """Events of each pixel as a share of the key's busiest pixel."""
    counts = events.groupBy(*keys, *pixel).agg(F.count("*").alias("n"))
    return counts.withColumn("edge", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


def pixel_activity(events: DataFrame, keys: list[str], pixel: list[str], times: float = 10.0) -> DataFrame:
    """Pixels that fired, and those with more than `times` the mean count of such pixels."""
    counts = events.groupBy(*keys, *pixel).agg(F.count("*").alias("n"))
    counts = counts.withColumn("mean", F.avg("n").over(Window.partitionBy(*keys)))
    return counts.groupBy(*keys).agg(F.count("*").alias("active"), F.count_if(F.col("n") > times * F.col("mean")).alias("hot"))


def stream_diagnostics(events: DataFrame, keys: list[str], width: float, min_rate: float = 1_000.0, max_rate: float = 5_000_000.0, pixels: DataFrame | None = None, n_pixels: int = 1) -> DataFrame:
    """Totals, rates, and windows that are empty, starved (a rate under min_rate, empty ones too) and overloaded (over
    max_rate) of each stream; with pixels (of pixel_activity) also the shares of n_pixels that were active and hot."""
    total = events.groupBy(*keys).agg(F.count("*").alias("total"), F.round(F.avg((F.col("p") > 0).cast("int")), 6).alias("positive"), (F.max("t") - F.min("t")).alias("span"))
    rate = F.col("n") / width
    counts = {"empty": F.col("n") == 0, "starved": rate < min_rate, "overloaded": rate > max_rate}
    rates = packets(events, keys, width).groupBy(*keys).agg(F.round(F.min(rate), 9).alias("min_rate"), F.round(F.max(rate), 9).alias("max_rate"), *[F.count_if(c).alias(f"{n}_windows") for n, c in counts.items()])
    mean = F.round(F.when(F.col("span") > 0, F.col("total") / F.col("span")).otherwise(0.0), 9)
    found = total.join(rates, keys)
    shares = []
    if pixels is not None:
        found = found.join(pixels, keys, "left")
        shares = [F.round(F.coalesce(c, F.lit(0)) / n_pixels, 6).alias(f"{c}_fraction") for c in ("active", "hot")]
    return found.select(*keys, "total", "positive", mean.alias("mean_rate"), "min_rate", "max_rate", *[f"{n}_windows" for n in counts], *shares)


def frames(events: DataFrame, keys: list[str], pixel: list[str], width: float) -> DataFrame:
    """keys, win, pixel, value (0..255, halves to even), centre: each packet's events per pixel as a share of its busiest."""
    span = events.groupBy(*keys).agg(F.min("t").alias("t0"), F.greatest(F.ceil((F.max("t") - F.min("t")) / width), F.lit(1)).alias("many"))
    numbered = events.join(span, keys).withColumn("win", F.least(F.floor((F.col("t") - F.col("t0")) / width), F.col("many") - 1))
    counts = numbered.groupBy(*keys, "win", *pixel).agg(F.count("*").alias("n"), F.min("t0").alias("t0"))
    share = F.col("n") / F.max("n").over(Window.partitionBy(*keys, "win"))
    return counts.select(*keys, "win", *pixel, F.bround(share * 255, 0).cast("int").alias("value"), (F.col("t0") + (F.col("win") + 0.5) * F.lit(width)).alias("centre"))


def centroid(pixels: DataFrame, keys: list[str], weight: str, x: str = "px", y: str = "py") -> DataFrame:
    """Weighted centre of each frame; (0, 0) for one without mass."""
    mass = F.sum(weight)
    return pixels.groupBy(*keys).agg(*[F.when(mass > 0, F.sum(F.col(c) * F.col(weight)) / mass).otherwise(0.0).alias(n) for c, n in ((x, "cx"), (y, "cy"))])
