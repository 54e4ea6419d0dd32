"""Registered queries of frames as patches, minibatches, estimators called from SQL and fusion under a policy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.frames import frame_patches
from trailmark.operators import plugins, policy, sampling
from trailmark.plans.catalogue import ORACLE_SQL, QUERIES, query
from trailmark.plans.motion import SQL_INERTIAL, inertial, rounded, rows_only
from trailmark.plans.tracking import SIDE, SQL_FRAMES, frames

#: Side of a resampled frame, and of a patch.
SMALL, PATCH = 6, 3


def m13_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = frames(spark, sf_dir).select("vec_id", F.posexplode(frame_patches(SMALL, PATCH)("pixels", F.lit(SIDE), F.lit(SIDE))).alias("tile", "cells"))
    return tiles.select("vec_id", "tile", F.posexplode("cells").alias("cell", "value")).select("vec_id", "tile", "cell", *rounded("value", to=5))


SQL_OVERLAP = f"(SELECT j, i, (least(i + 1, (j + 1) * {SIDE} / {SMALL}) - greatest(i, j * {SIDE} / {SMALL})) / ({SIDE} / {SMALL}) AS w FROM (SELECT unnest(range({SMALL})) AS j), (SELECT unnest(range({SIDE})) AS i) WHERE least(i + 1, (j + 1) * {SIDE} / {SMALL}) > greatest(i, j * {SIDE} / {SMALL}))"
QUERIES["m13_patches"] = m13_patches
ORACLE_SQL["m13_patches"] = f"""WITH {SQL_FRAMES},
scaled AS (SELECT vec_id, CASE WHEN list_max(p) > 1 THEN 255.0::DOUBLE ELSE 1 END AS s, p FROM f),
c AS (SELECT vec_id, i // {SIDE} AS y, i % {SIDE} AS x, least(greatest(p[i + 1] / s, 0), 1) AS v FROM scaled, (SELECT unnest(range({SIDE * SIDE})) AS i)),
r AS (SELECT vec_id, a.j AS y, b.j AS x, sum(a.w * b.w * v) AS v FROM c JOIN {SQL_OVERLAP} a ON a.i = c.y JOIN {SQL_OVERLAP} b ON b.i = c.x GROUP BY ALL),
t AS (SELECT vec_id, (y // {PATCH}) * {SMALL // PATCH} + x // {PATCH} AS tile, (y % {PATCH}) * {PATCH} + x % {PATCH} AS cell, v FROM r)
SELECT vec_id, tile::INT AS tile, cell::INT AS cell, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 5) + 0.0 AS value FROM t WINDOW w AS (PARTITION BY vec_id, tile)"""

BATCH, EPOCHS, DRAWN, SEED = 64, 2, 40, 5


def numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    return sampling.ranked(rows, "vec_id", 10_000), rows.count()


def t07_minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's batch in each of two epochs."""
    return sampling.minibatches(*numbered(spark, sf_dir), BATCH, EPOCHS, SEED).select("vec_id", "epoch", "place", "batch")


def t07_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of forty batches draws a vector, with replacement."""
    return sampling.draws(*numbered(spark, sf_dir), BATCH, DRAWN, SEED).select("vec_id", "batch", "times")


def sql_scrambled(value: str, seed: str, turn: int) -> str:
    first = f"(({value}) * {sampling.FACTOR + 2 * turn} + {seed} % {sampling.PRIME} + {turn * 7919}) % {sampling.PRIME}"
    return f"(({first}) * ((({first}) + {(turn + 1) * 104729}) % 65537)) % {sampling.PRIME}"


def sql_once(source: str) -> str:
    """Rows of source (epoch, rank, x, a, b, seed) with x moved on once."""
    out = f"SELECT epoch, rank, a, b, n, seed, x // b AS l, x % b AS r FROM {source}"
    for k in range(sampling.ROUNDS):
        out = f"SELECT * REPLACE ((l + {sql_scrambled('r', 'seed', 2 * k)}) % a AS l) FROM ({out})"
        out = f"SELECT * REPLACE ((r + {sql_scrambled('l', 'seed', 2 * k + 1)}) % b AS r) FROM ({out})"
    return f"SELECT epoch, rank, a, b, n, seed, l * b + r AS x FROM ({out})"


SQL_RANKS = "r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank, count(*) OVER () AS n FROM embeddings)"
QUERIES |= {f.__name__: f for f in (t07_minibatches, t07_draws)}
ORACLE_SQL["t07_minibatches"] = f"""WITH RECURSIVE {SQL_RANKS},
g AS (SELECT vec_id, rank, n, epoch, {SEED} + 1000003 * epoch AS seed, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM r, (SELECT unnest(range({EPOCHS})) AS epoch)),
h AS (SELECT epoch, rank, a, (n + a - 1) // a AS b, n, seed, rank AS x FROM g),
walk AS ({sql_once("h")} UNION ALL {sql_once("(SELECT * FROM walk WHERE x >= n)")})
SELECT vec_id, epoch::INT AS epoch, x AS place, x // least({BATCH}, walk.n) AS batch FROM walk JOIN r USING (rank) WHERE x < walk.n"""
SQL_LOW, SQL_HIGH = f"id % {sampling.PRIME}", f"id // {sampling.PRIME}"
ORACLE_SQL["t07_draws"] = f"""WITH {SQL_RANKS},
d AS (SELECT unnest(range({DRAWN} * least({BATCH}, (SELECT count(*) FROM embeddings)))) AS id),
k AS (SELECT id // least({BATCH}, (SELECT count(*) FROM embeddings)) AS batch, ({sql_scrambled(f'{SQL_LOW} + {SQL_HIGH}', str(SEED), 1)} * {sampling.PRIME} + {sql_scrambled(SQL_LOW, str(SEED), 2)}) % (SELECT count(*) FROM embeddings) AS rank FROM d)
SELECT vec_id, batch, count(*) AS times FROM k JOIN r USING (rank) GROUP BY ALL"""


@query(f"""{SQL_INERTIAL},
d AS (SELECT seq, r, CASE WHEN s > 0 THEN gx / s * sin(angle / 2) ELSE 0 END AS dx, CASE WHEN s > 0 THEN gy / s * sin(angle / 2) ELSE 0 END AS dy, CASE WHEN s > 0 THEN gz / s * sin(angle / 2) ELSE 0 END AS dz, CASE WHEN s > 0 THEN cos(angle / 2) ELSE 1 END AS dw
    FROM (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS angle, abs(gx) + abs(gy) + abs(gz) AS s FROM o)),
walk AS (SELECT seq, r, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM o WHERE r = 1
  UNION ALL SELECT d.seq, d.r, qw * dx + dw * qx + qy * dz - qz * dy, qw * dy + dw * qy + qz * dx - qx * dz, qw * dz + dw * qz + qx * dy - qy * dx, qw * dw - qx * dx - qy * dy - qz * dz FROM walk JOIN d ON d.seq = walk.seq AND d.r = walk.r + 1)
SELECT 'gyro' AS method, seq, r::DOUBLE AS t, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy, round(qz, 6) + 0.0 AS qz, round(qw, 6) + 0.0 AS qw FROM walk""")
def x01_backend(b: DataFrame) -> DataFrame:
    """The gyro estimator as a table function of SQL."""
    plugins.install(b.sparkSession)
    found = b.sparkSession.sql("SELECT * FROM estimate(method => 'gyro', samples => TABLE(SELECT seq, t, gx, gy, gz FROM {samples}) PARTITION BY seq ORDER BY t)", samples=inertial(b))
    return found.select("method", "seq", "t", *rounded("qx", "qy", "qz", "qw"))


def made_up_policy(methods: tuple[str, ...], period: float, seed: int = 3) -> policy.Policy:
    """A policy of random weights: what it decides means nothing, but is the same everywhere."""
    size, rng = len(methods) * len(policy.OF_METHOD) + len(policy.OF_ALL), np.random.default_rng(seed)
    layers = ((rng.normal(0, 0.4, (16, size)), rng.normal(0, 0.2, 16)), (rng.normal(0, 0.6, (len(methods), 16)), np.full(len(methods), 0.5)))
    return policy.Policy(methods, layers, np.full(size, 0.2), np.full(size, 0.5), period=period)


@rows_only
def x13_policy_run(b: DataFrame) -> DataFrame:
    """Odd rows as samples a second apart, clicks and views as positions that two methods offer; the trust log and updates."""
    imu = inertial(b)
    nth = imu.groupBy("seq").agg(F.max("t").alias("_last"))
    offers = b.where("method in ('click', 'view')").join(nth, "seq").select("seq", (F.lit(1.0) + F.pmod("idx", F.greatest(F.col("_last").cast("long") - 1, F.lit(1)))).alias("t"), "method", ((F.col("x") - 100) / 50).alias("x"), ((F.col("y") - 20) / 50).alias("y"), F.lit(0.0).alias("z"), "confidence", "health")
    offers = offers.groupBy("seq", "t", "method").agg(F.min_by(F.struct("x", "y", "z", "confidence", "health"), F.struct("x", "y", "confidence")).alias("v")).select("seq", "t", "method", "v.*")
    found = policy.policy_fusion(imu, offers, ["seq"], made_up_policy(("click", "view"), 4.0))
    return found.where("kind <> 'step'").select("seq", "kind", F.round("t", 3).alias("t"), "method", "accepted", "reason", *rounded("innovation", "d2", to=4), *rounded("trust"))
