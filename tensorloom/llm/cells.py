"""Cells of space: groups of vectors that lie near each other, for bounds on what a whole group can meet.

A tree of cuts is fit for each vector length on a sample of about SAMPLE rows, the only ones that come to the driver; it
sends every row to one of at most MOST_CELLS cells. A cell with more rows than a group may have is dealt out by hash, so
no group grows, whatever share of the rows lies in one place. The sample decides which rows are together, never a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import unpacked

SAMPLE, MOST_CELLS = 16_384, 1024
#: A cut's smaller side has one row of the sample in so many at least, else both have half.
LEAST_SHARE = 8


class Cells:
    """A complete binary tree of cuts: node i has an axis and a place on it; its children are 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        inner = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros((inner, points.shape[1])), np.zeros(inner)
        own = [np.unique(points, axis=0)] if inner else []
        for node in range(inner):
            x = own[node]
            if len(x) > 1:
                far = x[np.linalg.norm(x - x.mean(axis=0), axis=1).argmax()]
                self.axis[node] = far - x[np.linalg.norm(x - far, axis=1).argmax()]
                place = x @ self.axis[node]
                middle = (place.min() + place.max()) / 2  # between the two outermost: groups stay whole
                right = place > middle
                if min(right.sum(), len(x) - right.sum()) * LEAST_SHARE < len(x):
                    middle = np.median(place)
                    right = place > middle
                self.cut[node] = middle
            else:
                right = np.zeros(len(x), bool)
            own += [x[~right], x[right]]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.axis[node]) > self.cut[node])
        return (node - len(self.cut)).astype(np.int32)


def fit(rows: DataFrame, size: int) -> dict[int, Cells]:
    """The cuts for each length of rows (dim, id, x) that more than `size` of them have."""
    out = {}
    for r in rows.groupBy("dim").count().where(F.col("count") > size).collect():
        grain = 1 << 30
        share = min(grain, math.ceil(grain * SAMPLE / r["count"]))
        chosen = rows.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(grain)) < share))
        points = unpacked([p[0] for p in chosen.select("x").limit(2 * SAMPLE).collect()], r["dim"])
        out[r["dim"]] = Cells(points, min(MOST_CELLS, -(-r["count"] // size)))
    return out


def placed(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """rows (dim, id, x, ...) with cell int."""
    names = rows.columns

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & set(cells):
                own = np.flatnonzero(dims == dim)
                cell[own] = cells[dim].of(unpacked(batch.column("x").take(pa.array(own)).to_pylist(), dim))
            yield batch.append_column("cell", pa.array(cell))

    return rows.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int").select(*names, "cell")


def grouped(rows: DataFrame, size: int):
    """rows with dim, id and cell by dim, cell and sub: groups of about `size` rows of one cell."""
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("rows_"))  # a row per cell
    dealt = rows.join(counts, ["dim", "cell"]).withColumn("sub", F.expr(f"cast(pmod(xxhash64(29, id), (rows_ + {size - 1}) div {size}) as int)"))
    return dealt.drop("rows_").groupBy("dim", "cell", "sub")
