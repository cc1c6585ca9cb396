"""A stored vector index: rows in cells around centroids, so that a query compares itself with a share of the rows.

The mean of all vectors, which says nothing, is taken off. Centroids are learned on a sample of bounded size; every row is put into the
cell of its nearest one. A query takes cells in the order
of their centroids' cosines until they hold the share of rows it may look at, and compares itself exactly with all rows
of these. With a share of 1 the result is that of the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Rows that centroids are learned on, those with the smallest hashes of their id.
SAMPLE = 20_000
#: Centroids are held by the driver and every task.
MOST_CELLS = 4096
#: Rows of a cell that are compared in one task.
PART_ROWS = 50_000


def matrix(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """Vectors as rows of length 1, filled up or cut to size; a vector of zeros stays."""
    lists = column.to_pylist()
    size = max((len(v) for v in lists if v), default=0) if size is None else size
    out = np.zeros((len(lists), size))
    for i, v in enumerate(lists):
        out[i, : len(v or [])] = (v or [])[:size]
    return scaled(out)


def scaled(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms == 0, 1.0, norms)[:, None]


@dataclass
class Cells:
    """The mean that is taken off, and the centroids, rows of length 1."""

    mean: np.ndarray
    centres: np.ndarray

    def scores(self, vectors: pa.Array | pa.ChunkedArray | np.ndarray) -> np.ndarray:
        """The cosine of each vector with each centroid, after the mean is taken off."""
        held = vectors if isinstance(vectors, np.ndarray) else matrix(vectors, len(self.mean))
        return scaled(held - self.mean) @ self.centres.T

    def table(self, spark: SparkSession) -> DataFrame:
        """cell and centroid; the mean stands as cell -1."""
        return spark.createDataFrame([(i - 1, c.tolist()) for i, c in enumerate([self.mean, *self.centres])], "cell int, centroid array<double>")


def stored(table: DataFrame) -> Cells | None:
    """The cells of a table of at most MOST_CELLS + 1 rows; None if it is empty."""
    held = table.orderBy("cell").toArrow()
    if not held.num_rows:
        return None
    rows = np.array(held.column("centroid").to_pylist(), float).reshape(held.num_rows, -1)
    return Cells(rows[0], rows[1:])


def learned(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> Cells:
    """Cells of rows (id, embedding) by spherical k-means on at most `sample` of them; as many as told, or 8 times the square root of all rows,
    but one for each four rows at most.

    Rows without an embedding do not count; without any there is one cell of no dimension.
    """
    known = rows.where("embedding IS NOT NULL")
    n = known.count()
    held = matrix(known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).select("embedding").toArrow().column(0))
    if not len(held):
        return Cells(np.zeros(0), np.zeros((1, 0)))
    mean = held.mean(axis=0)
    held = scaled(held - mean)
    count = min(cells or max(1, min(round(8 * n**0.5), n // 4)), MOST_CELLS, len(held))
    rnd = np.random.default_rng(7)
    centres = held[rnd.choice(len(held), count, replace=False)]
    for _ in range(rounds):
        own = (held @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, held)
        empty = np.bincount(own, minlength=count) == 0
        sums[empty] = held[rnd.choice(len(held), int(empty.sum()))]
        centres = scaled(sums)
    return Cells(mean, centres)


def assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """id, document_id, cell and embedding of the rows that have an embedding."""

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        return pa.array(cells.scores(vectors).argmax(axis=1).astype(np.int32))

    known = rows.where("embedding IS NOT NULL")
    return known.select("id", "document_id", nearest("embedding").alias("cell"), "embedding")


def cells_topk(queries: DataFrame, index: DataFrame, cells: Cells, k: int, share: float = 0.1, digits: int = 9) -> DataFrame:
    """query_id, id, score and rank of each query's k rows of the largest cosine among the cells it looks at, smallest id first among equals.

    queries: query_id, vector; index: as assigned() gives it. A query looks at no more than `share` of the rows, but at one cell at least. Queries
    and rows meet by cell and part of a cell, as matrix products; only the best k of each go on.
    """
    from loomgraph.plans.store import checkpointed

    counts = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
    sizes = np.array([counts.get(c, 0) for c in range(len(cells.centres))])
    parts = np.maximum(1, -(-sizes // PART_ROWS))
    most = share * sizes.sum()

    @F.arrow_udf("array<struct<cell:int,part:int>>")
    def looked_at(vectors: pa.Array) -> pa.Array:
        order = np.argsort(-cells.scores(vectors), axis=1, kind="stable")
        out = []
        for row in order:
            row = row[sizes[row] > 0]
            n = max(1, int(np.searchsorted(np.cumsum(sizes[row]), most, "right")))
            out.append([{"cell": int(c), "part": p} for c in row[:n] for p in range(int(parts[c]))])
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())])))

    asked = queries.where("vector IS NOT NULL").select("query_id", "vector", F.explode(looked_at("vector")).alias("c"))
    asked = checkpointed(asked.select("query_id", "vector", "c.cell", "c.part"))
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
    # the cells named reach the scan: the index is sorted by cell
    per_cell = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)
    rows = index.where(F.col("cell").isin(wanted)).select("cell", F.pmod(F.xxhash64(F.col("id").cast("string")), per_cell).cast("int").alias("part"), "id", "embedding")
    schema = StructType().add("query_id", queries.schema["query_id"].dataType).add("id", index.schema["id"].dataType).add("score", DoubleType())

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        right = right.take(pc.sort_indices(right.column("id")))
        size = max(len(v) for v in left.column("vector").to_pylist() + right.column("embedding").to_pylist())
        score = np.round(matrix(left.column("vector"), size) @ matrix(right.column("embedding"), size).T, digits) + 0.0
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(left.num_rows), top.shape[1])
        return pa.table({"query_id": left.column("query_id").take(pa.array(at)), "id": right.column("id").take(pa.array(top.ravel())), "score": pa.array(score[at, top.ravel()])})

    found = asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
