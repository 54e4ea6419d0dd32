"""Nearest vectors of a stated query set among all rows, found block by block, and pairs that are each other's nearest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of each side that one task compares.
QUERY_BLOCK, ROW_BLOCK = 2_000, 10_000


#: Distances that are held at once.
AT_ONCE = 500_000


def _nearest(ids: np.ndarray, vectors: np.ndarray, other: np.ndarray, there: np.ndarray, k: int) -> pd.DataFrame:
    """id, other, distance: the k nearest of the other vectors of each, by matrix products of AT_ONCE distances at most.

    The product finds who may be among the k nearest; their distances, and ties, are then taken from the differences."""
    out = []
    squares = (there * there).sum(axis=1)
    step = max(1, AT_ONCE // max(1, len(other)))
    for at in range(0, len(ids), step):
        own, mine = ids[at : at + step], vectors[at : at + step]
        square = (mine * mine).sum(axis=1)[:, None] + squares - 2 * (mine @ there.T)
        square[own[:, None] == other] = np.inf
        last = np.partition(square, min(k, square.shape[1]) - 1, axis=1)[:, min(k, square.shape[1]) - 1]
        slack = 1e-9 * (1 + square[np.isfinite(square)].max(initial=0.0))
        row, column = np.nonzero((square <= last[:, None] + slack) & np.isfinite(square))
        distance = np.sqrt(((mine[row] - there[column]) ** 2).sum(axis=1))
        order = np.lexsort((other[column], distance, row))
        row, column, distance = row[order], column[order], distance[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append(pd.DataFrame({"id": own[row[keep]], "other": other[column[keep]], "distance": distance[keep]}))
    return pd.concat(out, ignore_index=True)


def near_in_blocks(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """side, id, other, distance: each query's two nearest rows in each block (side 0), each row's nearest query in each
    block of queries (side 1), by Euclidean distance, of equals the least id. A vector is not compared with its own id.

    Each block of queries meets each block of rows in one task of bounded size; only the best of a block leave it. Only
    the wanted sides are looked for. Both tables are counted first, as the numbers of blocks follow from their sizes.
    """
    many = [max(1, math.ceil(df.count() / block)) for df, block in ((queries, QUERY_BLOCK), (rows, ROW_BLOCK))]

    def dealt(df: DataFrame, own: str, other: str, n: int, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(own)
        kept = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), place)
        return kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def side_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table.column("v").combine_chunks()
        return table.column("id").to_numpy(), values.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        fields = pa.schema([("side", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])
        if not len(q) or not len(r):
            return fields.empty_table()
        both = [side_of(q), side_of(r)]
        found = pd.concat([_nearest(*both[s], *both[1 - s], k).assign(side=s)[["side", "id", "other", "distance"]] for s, k in ((0, 2), (1, 1)) if s in sides], ignore_index=True)
        return pa.Table.from_pandas(found, fields, preserve_index=False)

    left, right = dealt(queries, "qb", "rb", *many).groupBy("qb", "rb"), dealt(rows, "rb", "qb", *many[::-1]).groupBy("qb", "rb")
    return left.cogroup(right).applyInArrow(compare, "side int, id long, other long, distance double")


def ratio_matches(queries: DataFrame, rows: DataFrame, id_col: str = "id", vector: str = "v", ratio: float = 0.75) -> DataFrame:
    """id, near, distance, second, good: each query's nearest row; good if it is nearer than `ratio` of the second. A
    query with fewer than two others is not good; without any it has no row, as has a null vector."""
    ranked = near_in_blocks(queries, rows, id_col, vector, sides=(0,)).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).where("rank <= 2")
    found = ranked.groupBy("id").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(n) for r, c, n in ((1, "other", "near"), (1, "distance", "distance"), (2, "distance", "second"))])
    return found.withColumn("good", F.coalesce(F.col("distance") < ratio * F.col("second"), F.lit(False)))


def mutual_matches(queries: DataFrame, rows: DataFrame, id_col: str = "id", vector: str = "v", most: int = 250) -> DataFrame:
    """id, near, distance: the `most` closest pairs of a query and a row that are each other's nearest."""
    ranked = near_in_blocks(queries, rows, id_col, vector).withColumn("rank", F.row_number().over(Window.partitionBy("side", "id").orderBy("distance", "other"))).where("rank = 1")
    one = ranked.where("side = 0").select("id", F.col("other").alias("near"), "distance")
    back = ranked.where("side = 1").select(F.col("id").alias("near"), F.col("other").alias("id"))
    return one.join(back, ["id", "near"]).orderBy("distance", "id").limit(most)
