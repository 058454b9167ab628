"""Connected components of an edge table, in Spark: forests of each task's edges, then large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import dropped, shipped, written


#: So many edges, two numbers each, one task joins by itself; beyond, steps over all tasks go on until nothing changes.
ONE_TASK = 200_000


def forest():
    """Union-find whose roots are the smallest members: (find, join, all nodes' links upwards)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)

    return find, join, root


def _stars(batches):
    """A run's edges as stars about the smallest node; a run has at most ONE_TASK edges."""

    def stars(find, root):
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])

    find, join, root = forest()
    seen = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            join(u, v)
            seen += 1
            if seen == ONE_TASK:
                yield stars(find, root)
                (find, join, root), seen = forest(), 0
    yield stars(find, root)


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node that has an edge (a, b); the component is the smallest node reachable.

    Edges may repeat, run either way and join a node to itself. No edges: no rows. Each step aggregates a
    minimum per node before it shuffles, so a node with very many edges costs one row per map task and the
    star it forms has one edge per member; the steps end when the edge set no longer changes. Up to ``one_task`` edges,
    counted, are joined in one task.
    """
    spark = edges.sparkSession
    shipped(spark)
    stars = "u long, v long"
    pairs = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    now, path = written(pairs.mapInArrow(_stars, stars).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    if mark[0] <= one_task:
        return _named(written(now.repartition(1).mapInArrow(_stars, stars).where("u <> v"), "edges")[0])
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written out, so both sides of each join are plain exchanges and Spark may split a hot node's rows.
        low, low_at = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        # large star: every larger neighbour is tied to the smallest one
        large, large_at = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: every smaller neighbour, and the node itself, is tied to the smallest one
        # (a node has few smaller neighbours now, so their minimum needs no table of its own)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new, at = written(small, "edges")
        before, mark = mark, _mark(new)
        dropped(spark, path, low_at, large_at)
        path, now = at, new
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return _named(now)


def _named(now: DataFrame) -> DataFrame:
    """A star's members and its centre, each with the centre."""
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
