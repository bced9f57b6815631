"""Connected components of links, without ever holding them in one place.

Links first shrink to a spanning forest in each task. If what is left fits one task with
room to spare (`SMALL` edges, a few MB) one executor finishes it; else large-star and
small-star rounds alternate, with the same result: in a large star every node hands its larger
neighbours to the smallest it sees, in a small star its smaller ones. Edges never grow in
number and each round is two aggregations and two joins; rounds are logarithmic in the
longest chain. Each round's edges are written to the shared folder, so a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

MOST_ROUNDS = 60
SMALL = 200_000


def forest(batches):
    """Arrow batches of (u, v) to the spanning stars of their components; one task's links shrink to its nodes."""
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def star():
        nodes = [x for x in parent if root(x) != x]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes, dtype=np.int64)), pa.array(np.array([root(x) for x in nodes], dtype=np.int64))], names=["u", "v"]
        )
        parent.clear()
        return out

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * SMALL:
            yield star()
    if parent:
        yield star()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """node, root for every node of `links` (u, v: long) that is not the smallest of its component."""
    ship(links.sparkSession)
    tidy = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut(tidy.mapInArrow(forest, "u long, v long").distinct())
    if edges.count() <= small:
        done = edges.coalesce(1).mapInArrow(forest, "u long, v long")
        return done.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(MOST_ROUNDS):
        edges = cut(_small(_large(edges).distinct()).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
