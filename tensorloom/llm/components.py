"""Connected components of links, by alternating large and small stars on DataFrames.

Up to LINKS_A_TASK links are one task's work. Beyond that no node's links are ever gathered: each step is a minimum by key (partial sums before the shuffle) and a join back, whose
hot keys adaptive execution splits. Each round is written to the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Links up to which one task finds the components by itself; more go round by round.
LINKS_A_TASK = 500_000


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v long) as stars: within each task, every node with the least node of its component there."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """node, component: the least node reachable, for every node of links (null ends and loops are no links)."""
    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"`{u}` is not null and `{v}` is not null").where("u <> v")
    edges = written(links, "edges")
    tasks = -(-edges.count() // LINKS_A_TASK) if LINKS_A_TASK else 2
    stars = written(forest(edges.coalesce(max(1, tasks))) if tasks <= 1 else forest(edges).distinct(), "links")
    before = None
    while tasks > 1:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # larger neighbours to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = written(small.distinct(), "links")
    return stars.withColumnsRenamed({"u": "node", "v": "component"}).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
