"""Connected components of a graph given by its links, without any driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_narrow

#: A graph of up to this many links (16 bytes each), after tasks have reduced their own to forests, is finished in one task.
TOGETHER = 1_000_000
#: A task keeps at most this many nodes at once.
MOST_NODES = 2_000_000

#: The forests of all tasks are written to this many files for each core.
FILES_A_CORE = 2


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what a task's links connect, each node but the least of its part hung on the least."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    def flush() -> pa.RecordBatch:
        nodes = [(root(x), x) for x in up]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in nodes], pa.int64()), pa.array([b for _, b in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > MOST_NODES:
            yield flush()
    yield flush()


def _size(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return got[0], got[1]


def connected_components(links: DataFrame, a: str, b: str, together: int = TOGETHER) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of a link.

    Each task first reduces its own links to a forest.  If ``together`` links or fewer are left, one task
    joins the forests.  Otherwise large-star and small-star rounds alternate: each node's neighbours are
    hung on the least of them until every component is a star or few links are left.  A node's
    neighbours are never gathered: the least is a partial aggregate, and
    hanging is a join with one row per node, written first so that both sides are plain
    shuffles and Spark can split hot nodes.
    Null ends and self-links are ignored; repeated links count once.
    """
    edges = links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x and y and a < b").select("a", "b")
    edges = cut_narrow(edges.mapInArrow(forest, "a long, b long"), FILES_A_CORE * links.sparkSession.sparkContext.defaultParallelism, heavy=True)
    before = _size(edges)
    while before[0] > together:
        # large star: every neighbour above the node goes to the least of node and neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        # small star: node and its lesser neighbours go to the least neighbour
        least = cut(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")))
        below = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = cut(below.where("a < b").unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        after = _size(edges)
        if after == before:
            break
        before = after
    else:
        edges = cut(edges.coalesce(1).mapInArrow(forest, "a long, b long"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
