"""Exact nearest-neighbour search and similarity joins that leave out what the triangle inequality rules out.

Angles between vectors are a metric. Every vector belongs to the cell of its nearest pivot and is stored with its angle to it.
For a query at the angle a from a pivot, a member at the angle m is at least |a - m| away, so that cells, and bands of angles
within a cell, that are farther than the k-th best found so far are not read; and two vectors within an angle e of each other
have pivots whose angles to either differ by e at most, which bounds the cells that a join has to copy a vector to.

Pivots are a bounded sample (`PIVOTS`, by a hash of the id: the same ones each time); they decide how much is read, never the
result. Where vectors spread evenly in many dimensions, angles to pivots are all alike and little can be left out; the number
of rows that were read is returned.

Cosines are rounded to nine digits before they are ranked; equal ones go by id. A join's threshold is held against the cosine as it is. Vectors without a direction (null,
zero, another length than the pivots') are in no cell and near nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.session import kept

PIVOTS = 256
DIGITS = 9
#: Slack of bounds, in radians, for rounding: a cosine of nine digits near 1 is an angle of some 1e-4.
SLACK = 1e-4
#: What the product of two unit vectors may lack by rounding.
NOISE = 1e-14
#: Cells that a search reads first.
FIRST_CELLS = 4
#: Rows of a cell that a join multiplies at once.
BLOCK_ROWS = 2048
#: Entries of vectors that a task of a join is dealt, about.
TASK_ENTRIES = 1 << 23


def angle(cosine: float) -> float:
    return math.acos(max(-1.0, min(1.0, cosine)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def pivots_of(rows: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors of a sample of rows (id, vector) with a direction, of the length that most of them have."""
    good = rows.where("vector is not null and exists(vector, x -> x != 0)").select("id", "vector", F.size("vector").alias("dim"))
    common = good.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return np.zeros((0, 0))
    some = good.where(F.col("dim") == common["dim"]).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return _unit(np.array([r["vector"] for r in some], np.float64))


def celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with `cell`, the number of the nearest pivot, and `angle` to it; rows without a direction are left out."""
    dim = pivots.shape[1]
    spread = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.asarray(column.value_lengths().fill_null(-1))
            batch = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            v = np.asarray(batch.column("vector").flatten().cast(pa.float64()).fill_null(0)).reshape(-1, dim)
            some = np.flatnonzero((v * v).sum(1) > 0)
            if not len(some):
                continue
            near = _unit(v[some]) @ pivots.T
            cell = near.argmax(1).astype(np.int32)
            turn = np.arccos(np.clip(near[np.arange(len(some)), cell], -1, 1))
            batch = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(turn)], [*batch.schema.names, "cell", "angle"])

    if not dim:
        return rows.limit(0).withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    return rows.mapInArrow(run, f"{spread}, cell int, angle double")


class VectorIndex:
    """Vectors in a folder by cell, sorted by angle, and the reach of every cell."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.rows = spark.read.parquet(f"{folder}/rows")
        cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # one row a pivot
        self.cell = np.array([c["cell"] for c in cells], np.int64)
        self.pivot = np.array([c["pivot"] for c in cells], np.float64).reshape(len(cells), -1 if cells else 0)
        self.least, self.most = (np.array([c[k] for c in cells], np.float64) for k in ("least", "most"))
        self.n = np.array([c["n"] for c in cells], np.int64)

    @classmethod
    def write(cls, rows: DataFrame, folder: str, most: int = PIVOTS) -> VectorIndex:
        """An index of rows (id, vector, ...) in a folder that does not exist. Large cells are dealt over several files."""
        spark, pivots = rows.sparkSession, pivots_of(rows, most)
        dealt = celled(rows, pivots)
        dealt = dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "angle")
        dealt.write.partitionBy("cell").option("parquet.block.size", 1 << 22).parquet(f"{folder}/rows")
        if not len(pivots):
            schema = "cell int, n bigint, least double, most double, pivot array<double>"
            rows.limit(0).select("id", "vector", F.lit(0.0).alias("angle"), F.lit(0).alias("cell")).write.mode("overwrite").parquet(f"{folder}/rows")
            spark.createDataFrame([], schema).write.parquet(f"{folder}/cells")
            return cls(spark, folder)
        stored = spark.read.parquet(f"{folder}/rows")
        named = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>")
        reach = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
        reach.join(F.broadcast(named), "cell").write.parquet(f"{folder}/cells")
        return cls(spark, folder)

    def nearest(self, query: Sequence[float], k: int) -> tuple[DataFrame, dict[str, int]]:
        """(id, cosine) of the k nearest rows by cosine, then id, as a scan would find them; and how many rows and cells there are and were read."""
        q = np.asarray(query, np.float64)
        told = {"rows": int(self.n.sum()), "read": 0, "cells": len(self.cell), "cells_read": 0}
        if not len(self.cell) or len(q) != self.pivot.shape[1] or not q.any():
            return self.rows.select("id", F.lit(0.0).alias("cosine")).limit(0), told
        turn = np.arccos(np.clip(self.pivot @ (q / np.sqrt(q @ q)), -1, 1))
        # A member is at least as far as the query is from the band of the cell's angles.
        bound = np.maximum(0, np.maximum(turn - self.most, self.least - turn))
        order = np.lexsort((self.cell, turn, bound))
        first = order[: max(FIRST_CELLS, int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1)]
        score = F.round(ranking.cosine_to(query)("vector"), DIGITS)

        def read(cells: np.ndarray, reach: float | None) -> DataFrame:
            rows = self.rows.where(F.col("cell").isin([int(c) for c in self.cell[cells]]))
            if reach is not None:  # within a cell, only angles that differ from the query's by no more
                low = F.create_map(*[F.lit(x) for c in cells for x in (int(self.cell[c]), float(turn[c] - reach))])
                high = F.create_map(*[F.lit(x) for c in cells for x in (int(self.cell[c]), float(turn[c] + reach))])
                least, most = float((turn[cells] - reach).min()), float((turn[cells] + reach).max())
                rows = rows.where(F.col("angle").between(least, most) & F.col("angle").between(low[F.col("cell")], high[F.col("cell")]))
            return rows.select("id", "vector")

        found = read(first, None).select(score.alias("cosine")).orderBy(F.desc("cosine")).limit(k).collect()
        reach = angle(found[-1][0]) + SLACK if len(found) == k else math.pi
        chosen = np.flatnonzero(bound <= reach)
        rows = read(chosen, reach)
        told |= {"read": rows.count(), "cells_read": len(chosen)}
        return rows.select("id", score.alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k), told


def near_pairs(rows: DataFrame, threshold: float, by: Sequence[str] = (), most: int = PIVOTS) -> tuple[DataFrame, dict[str, int]]:
    """(id_a, id_b, cosine), id_a < id_b, of all pairs of rows (id, vector, by...) that agree in `by` and reach a threshold above 0; and how many products of vectors that took.

    Two such vectors x and y are within e, the threshold's angle. x goes to its own cell and to each cell whose pivot could be y's nearest: its angle to that
    pivot is at most 2e more than to its own pivot, and at most e more than the cell's reach. A pair is found in the cell of the one whose cell has the
    greater number (of its second id if both are of one cell). Cells of any size are cut into tiles, so that no task holds one.
    """
    spark, e = rows.sparkSession, angle(threshold) + SLACK
    pivots = pivots_of(rows, most)
    id_type = rows.schema["id"].dataType.simpleString()
    if not len(pivots):
        return spark.createDataFrame([], f"id_a {id_type}, id_b {id_type}, cosine double"), {"products": 0, "all": 0}
    own = kept(celled(rows.select("id", "vector", *by), pivots))
    reach = np.full(len(pivots), -1.0)
    for cell, far in own.groupBy("cell").agg(F.max("angle")).collect():  # one row a pivot
        reach[cell] = far
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(np.asarray(batch.column("vector").flatten().cast(pa.float64()).fill_null(0)).reshape(batch.num_rows, -1))
            turn = np.arccos(np.clip(v @ pivots.T, -1, 1))
            home = np.asarray(batch.column("cell"))
            fits = (turn <= (np.asarray(batch.column("angle")) + 2 * e)[:, None]) & (turn <= reach[None, :] + e)
            # Only to cells of a greater number: the other of a pair comes the other way.
            fits &= np.arange(len(pivots))[None, :] > home[:, None]
            which, cell = np.nonzero(fits)
            which = np.concatenate([np.arange(batch.num_rows), which])
            out = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([home, cell]).astype(np.int32))], [*out.schema.names, "at"])

    spread = own.mapInArrow(copied, f"{names}, at int").withColumn("guest", F.col("at") != F.col("cell"))
    key = ["at", *by]
    sizes = spread.groupBy(*key).agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    sizes = kept(sizes.where("homes > 0"))
    told = sizes.agg(F.sum(F.col("homes") * (F.col("homes") - 1) / 2 + F.col("homes") * F.col("guests")).cast("bigint")).first()[0] or 0
    total = own.groupBy(*by).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).cast("bigint")).first()[0] or 0
    blocks = sizes.select(*key, F.ceil(F.col("homes") / BLOCK_ROWS).cast("int").alias("tiles"))
    met = spread.join(blocks, key).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # Homes meet the homes of each tile once (i <= j), guests all tiles of homes.
    every = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    guest = F.col("guest")
    part = F.when(guest, F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.col("tiles")))).otherwise(F.lit(0))
    pairs = every.withColumns({"i": F.when(guest, F.lit(-1) - part).otherwise(F.least("tile", "other")).cast("int"), "j": F.when(guest, F.col("other")).otherwise(F.greatest("tile", "other"))})
    # A tile of homes is also the other side of the guests' products: a copy for each part of the guests.
    hosts = met.where(~guest).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"i": (F.lit(-1) - F.col("p")).cast("int"), "j": F.col("tile")})
    wanted = ["id", "vector", *key, "guest", "tile", "i", "j"]
    dealt = pairs.select(wanted).unionByName(hosts.select(wanted))
    # Dealt anew by the tiles that meet, or all copies of a cell's rows would stay in the cell's task.
    copies, meetings = sizes.agg(F.sum((F.col("guests") + 2 * F.col("homes")) * F.ceil(F.col("homes") / BLOCK_ROWS)), F.sum(2 * F.ceil(F.col("homes") / BLOCK_ROWS) ** 2)).first()
    tasks = max(-(-int(copies or 0) * pivots.shape[1] // TASK_ENTRIES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(max(1, min(int(meetings or 0), tasks)), *key, "i", "j")

    def multiply(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        v = _unit(np.asarray(table.column("vector").combine_chunks().flatten().cast(pa.float64()).fill_null(0)).reshape(table.num_rows, -1))
        tile, guest = np.asarray(table.column("tile")), np.asarray(table.column("guest").combine_chunks().cast(pa.int8()))
        a = np.flatnonzero(guest == 1) if i < 0 else np.flatnonzero(tile == i)
        b = np.flatnonzero(guest == 0) if i < 0 else np.flatnonzero(tile == j)
        rank = order_of(table.column("id"))
        left, right, scores = [], [], []
        for start in range(0, len(a), 256):
            some = a[start : start + 256]
            product = v[some] @ v[b].T
            x, y = np.nonzero(product >= threshold - NOISE)
            x, y, near = some[x], b[y], np.round(product[x, y], DIGITS)
            once = rank[x] < rank[y] if i == j else rank[x] != rank[y]
            x, y, near = x[once], y[once], near[once]
            swap = rank[x] > rank[y]
            left.append(np.where(swap, y, x))
            right.append(np.where(swap, x, y))
            scores.append(near)
        take = lambda parts: table.column("id").take(pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        return pa.table({"id_a": take(left), "id_b": take(right), "cosine": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    found = dealt.groupBy(*key, "i", "j").applyInArrow(multiply, f"id_a {id_type}, id_b {id_type}, cosine double")
    return found, {"products": told, "all": total}


def order_of(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id, of any type, among the sorted ones; equal ids have one place."""
    return pc.rank(ids.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
