"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots (at most ``pivots`` vectors, those with the smallest id hashes) split data and queries
into cells. A cell's summary is its number of vectors, its largest distance to the pivot and its
``k + 1`` smallest ones. From the summaries a query gets a bound its k-th score cannot be below
(q . pivot - |q| times the distance, over the nearest vectors of all cells) and for each cell a
score none of its vectors can exceed (q . pivot + |q| times the radius). Only cells that reach
the bound are needed.

Queries of neighbouring cells form groups of about ``group`` queries; a cell is replicated
only to the groups in which a query needs it. Groups and cells are dealt in blocks of bounded
size, so one task holds at most one group and ``block`` vectors, and a cell with a third of all
vectors is many tasks. Each solves its block by one matrix product; the k best of each query and
block meet in a last ranking.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter
vectors are continued with zeros. Ties go to the smaller vec_id. Rows that share a vec_id are
each a candidate, for a query all rows but those with its own id; the query's vector is that of the
smallest row. A null vec_id takes no part. Components are floor(scale * x) as integers; scores are
exact while their sums stay below 2 ** 53. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocal.llm.common import named
from aerocal.session import materialise


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<i8").reshape(len(vectors), -1).astype(np.float64)


def integer_vectors(
    data: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, vector as little-endian 64-bit integers); rows that take no part are left out."""
    rows = data.select(
        named(id_col).cast("long").alias("vec_id"),
        F.transform(named(vector_col), lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
        F.forall(
            named(vector_col),
            lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
            & (F.abs(x.cast("double")) != float("inf")),
        ).alias("finite"),
    ).where("vec_id is not null and vector is not null and finite")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0  # one number

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for vector in batch.column(1).to_pylist():
                row = np.zeros(max(1, width), "<i8")
                row[: len(vector)] = vector
                packed.append(row.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "vector"]
            )

    return rows.select("vec_id", "vector").mapInArrow(lay_out, "vec_id long, vector binary")


class Cells:
    """Pivots and, once known, the summaries of their cells; bounded by the number of pivots."""

    def __init__(self, pivots: np.ndarray, k: int) -> None:
        self.pivots, self.k = pivots, k
        self.count = np.zeros(len(pivots), np.int64)
        self.radius = np.zeros(len(pivots))
        self.nearest = np.full((len(pivots), k + 1), np.inf)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each vector, and the distance to it."""
        squares = (x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)
        cell = squares.argmin(1)
        away = np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))
        return cell, away * (1 + 1e-9)

    def needed(self, q: np.ndarray) -> np.ndarray:
        """For each query, which cells can hold one of its k best (its own row may be a candidate)."""
        at_pivot = q @ self.pivots.T
        norm = np.sqrt((q**2).sum(1))[:, None] * (1 + 1e-9)
        low = at_pivot[:, :, None] - norm[:, :, None] * self.nearest[None]
        low = low.reshape(len(q), -1)
        if low.shape[1] > self.k:
            bound = np.partition(low, low.shape[1] - self.k - 1, axis=1)[:, -self.k - 1]
        else:
            bound = np.full(len(q), -np.inf)
        return (at_pivot + norm * self.radius >= bound[:, None] - 1e-6) & (self.count > 0)

    def groups(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First group of each cell's queries and in how many groups they are split.

        Cells are taken in a chain of nearest neighbours and put together up to ``size`` queries.
        """
        left, at = set(range(1, len(self.pivots))), 0
        first, split = np.zeros(len(queries), np.int64), np.ones(len(queries), np.int64)
        group = held = 0
        while True:
            n = int(queries[at])
            if n > size:
                group += held > 0
                first[at], split[at] = group, -(-n // size)
                group, held = group + int(split[at]), 0
            else:
                if held + n > size:
                    group, held = group + 1, 0
                first[at], held = group, held + n
            if not left:
                return first, split
            rest = np.array(sorted(left))
            at = int(rest[((self.pivots[rest] - self.pivots[at]) ** 2).sum(1).argmin()])
            left.remove(at)


def _solve(k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(data):
            return none
        q = np.frombuffer(b"".join(queries["vector"]), "<i8").reshape(len(queries), -1).astype(float)
        x = np.frombuffer(b"".join(data["vector"]), "<i8").reshape(len(data), -1).astype(float)
        ids, own = data["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out = []
        for at in range(0, len(q), 256):
            score = q[at : at + 256] @ x.T
            score[own[at : at + 256, None] == ids[None]] = -np.inf
            m = min(k, score.shape[1])
            cut = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
            for row, least, query in zip(score, cut, own[at : at + 256]):
                over = np.flatnonzero(row > least)
                ties = np.flatnonzero(row == least)[: m - len(over)]
                best = np.concatenate([over, ties])
                best = best[np.isfinite(row[best])]
                out.append((np.full(len(best), query), ids[best], row[best].astype(np.int64)))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return solve


def top_k(
    vectors: DataFrame, is_query, k: int = 20, pivots: int = 64, group: int = 1024, block: int = 8192
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    base = materialise(vectors, "vectors")
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = Cells(np.unique(_matrix(chosen.column("vector").combine_chunks()), axis=0), k)
    model = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, away = model.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)],
                    ["vec_id", "vector", "cell", "away"],
                )

    placed = materialise(
        base.mapInArrow(place, "vec_id long, vector binary, cell int, away double"), "placed"
    )
    near = placed.select("cell", "away", F.row_number().over(
        Window.partitionBy("cell").orderBy("away")).alias("place")).where(F.col("place") <= k + 1)
    for row in near.collect():  # k + 1 numbers for each pivot
        cells.nearest[row.cell, row.place - 1] = row.away
    queries = placed.where(is_query)
    own = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.min("cell").alias("cell"))
    asked = np.zeros(len(cells.pivots), np.int64)
    for row in own.groupBy("cell").agg(F.count("*").alias("n")).collect():
        asked[row.cell] = row.n
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        cells.count[row.cell], cells.radius[row.cell] = row.n, row.r
    first, split = cells.groups(asked, group)
    chunks = -(-cells.count // block)
    plan = spark.createDataFrame(
        [(c, int(first[c]), int(split[c]), int(chunks[c])) for c in range(len(first))],
        "cell int, first long, split long, chunks long",
    )
    summary = spark.sparkContext.broadcast(cells)

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                wanted = [np.flatnonzero(r).tolist() for r in summary.value.needed(_matrix(some.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(wanted, pa.list_(pa.int32()))],
                    ["vec_id", "vector", "grp", "cells"],
                )

    part = F.pmod(F.xxhash64("vec_id"), F.col("split"))
    grouped = materialise(
        own.join(F.broadcast(plan), "cell")
        .select("vec_id", "vector", (F.col("first") + part).alias("grp"))
        .mapInArrow(need, "vec_id long, vector binary, grp long, cells array<int>"),
        "queries",
    )
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    needs = materialise(grouped.select("grp", F.explode("cells").alias("cell")).distinct(), "needs")
    data = (
        placed.join(F.broadcast(plan), "cell")
        .select("vec_id", "vector", "cell", chunk.alias("chunk"))
        .join(needs, "cell")
        .select("grp", "cell", "chunk", "vec_id", "vector")
    )
    sent = (
        grouped.select("grp", "vec_id", "vector", F.explode("cells").alias("cell"))
        .join(F.broadcast(plan), "cell")
        .select("grp", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
                "vec_id", "vector")
    )
    key = ["grp", "cell", "chunk"]
    best = sent.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(
        _solve(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
