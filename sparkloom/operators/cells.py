"""Approximate nearest neighbours: coarse cells of vectors in folders, a few of them probed, exact cosines inside.

Centroids come from spherical k-means over a hash sample of SAMPLE rows at most; every row is indexed, in the folder of its nearest
centroid. A query reads the cells of its ``probes`` nearest centroids only and scores their vectors exactly, so what it finds is right in
score and order; what it can miss is a neighbour in a cell that it did not probe. With all cells probed the result is that of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkloom.operators.retrieval import ROW_BLOCK, Top, _blocks, _unit
from sparkloom.runtime import cut, stored

#: Rows that centroids are fitted on, rows of a cell as a rule, steps of the fit, and cells at most (each is a folder).
SAMPLE, CELL, STEPS, MOST = 20_000, 200, 12, 4096
#: Rows of one file of a cell; a larger cell is dealt over several.
PART = 50_000


@dataclass(frozen=True)
class Cells:
    """Rows (cell, part, doc, v) in a folder for each cell, and the centroids, at most MOST of them."""

    rows: DataFrame
    centroids: np.ndarray


def _nearest(centroids: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first; ties go to the smaller number."""
    return np.argsort(-np.round(_unit(m) @ centroids.T, 9), axis=1, kind="stable")[:, :n]


def fit(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means from a fixed seed; an empty cell takes the row that is farthest from its centroid."""
    m = _unit(vectors)
    centroids = m[np.random.default_rng(seed).choice(len(m), cells, replace=False)]
    for _ in range(STEPS):
        like = m @ centroids.T
        own = like.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, m)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = m[np.argsort(like.max(axis=1), kind="stable")[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def cell_index(vectors: DataFrame, id_col: str = "doc_id", vector_col: str = "vector", cells: int | None = None, path: str | None = None) -> Cells:
    """Index every row with a vector, under ``path`` or in the checkpoint folder; ids keep their type."""
    rows = vectors.select(F.col(id_col).alias("doc"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return Cells(stored(rows.withColumns({"cell": F.lit(0), "part": F.lit(0)}), path, by="cell"), np.empty((0, 0)))
    drawn = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("doc", F.lit("cells")), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
    sample = np.array([r[0] for r in drawn.orderBy(F.xxhash64("doc")).limit(SAMPLE).select("v").collect()])
    centroids = fit(sample, max(1, min(cells or -(-n // CELL), MOST, len(sample))))

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        return pa.array(_nearest(centroids, np.vstack(v.to_numpy(zero_copy_only=False)), 1)[:, 0].astype(np.int32))

    dealt = cut(rows.withColumn("cell", cell("v")))
    # Large cells, such as one that many equal vectors share, are dealt over several parts of about PART rows.
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # MOST rows at most
    parts = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / PART)).cast("int").alias("part")
    placed = dealt.join(F.broadcast(sizes), "cell").select("doc", "v", "cell", parts)
    return Cells(stored(placed.repartition("cell", "part"), path, by="cell"), centroids)


def cell_knn(index: Cells, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None, keep_self: bool = True) -> DataFrame:
    """(query, doc, score, rank): the k best rows, by exact cosine, of the ``probes`` cells nearest to each query.

    ``where`` may use ``doc`` and ``cell``. Queries go out in blocks, as in the exact search; a block opens the folders of its cells only.
    A task keeps the k best rows a query over all of its cells, so that what it holds and passes on grows with neither cells nor rows.
    """
    spark = queries.sparkSession
    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField("doc", index.rows.schema["doc"].dataType), StructField("score", DoubleType())])
    rows = index.rows if where is None else index.rows.where(where)
    best: DataFrame | None = None
    for ids, matrix in _blocks(queries) if len(index.centroids) else ():
        near = _nearest(index.centroids, matrix, min(probes, len(index.centroids)))
        every = near.shape[1] == len(index.centroids)
        shared = spark.sparkContext.broadcast((ids, matrix, None if every else near.astype(np.int16)))

        probed = rows if every else rows.where(F.col("cell").isin(*map(int, np.unique(near))))
        part = probed.select("cell", "doc", "v").mapInArrow(_scorer(shared, k, keep_self), schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    order = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "doc")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scorer(shared, k: int, keep_self: bool):
    """The function of one task: the k best of its rows for each query, each row scored for the queries that probe its cell."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, near = shared.value
        top = Top(len(ids), k)
        place = {} if keep_self else {d: i for i, d in enumerate(ids)}
        kind = None
        for batch in (b.slice(at, ROW_BLOCK) for b in batches for at in range(0, b.num_rows, ROW_BLOCK)):
            kind = batch.schema.field("doc").type
            cell, doc = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), dtype=object)
            m = _unit(np.vstack(batch.column(2).to_numpy(zero_copy_only=False)))
            if near is None:
                like = q @ m.T
            else:
                like = np.full((len(ids), len(doc)), -np.inf)
                for c in np.unique(cell):
                    which, here = np.flatnonzero((near == c).any(axis=1)), np.flatnonzero(cell == c)
                    like[np.ix_(which, here)] = q[which] @ m[here].T
            for j, d in enumerate(doc) if place else ():
                if (i := place.get(d)) is not None:
                    like[i, j] = -np.inf
            top.offer(like, doc)
        if kind is not None:
            i, doc, found = top.ends()
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i]), pa.array(doc.tolist(), kind), pa.array(found)], ["query", "doc", "score"])

    return score


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact list's rows whose score the found list reaches: of rows of one score, any will do."""
    key = ["query", "rank"]
    both = exact.select(*key, F.col("score").alias("e")).join(found.select(*key, F.col("score").alias("f")), key, "left")
    got = both.agg(F.avg(F.when(F.col("f") >= F.col("e") - 1e-9, 1.0).otherwise(0.0))).first()[0]
    return 1.0 if got is None else got
