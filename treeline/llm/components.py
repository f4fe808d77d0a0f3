"""Connected components of an edge table, by alternating large-star and small-star steps (no driver-side graph)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same for few edges: a union-find over one task's long columns, roots by smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while above[top] != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                above.setdefault(a, a)
                above.setdefault(b, b)
                x, y = find(a), find(b)
                above[max(x, y)] = min(x, y)
        nodes = np.array(list(above), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([find(x) for x in above], np.int64))], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, most_rounds: int = 60, one_task: int = 200_000) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: longs) reaches.

    Up to ``one_task`` edges (a checked count) are settled in one task. More go in rounds over tables: each round keeps at
    most as many edges as the last, and hubs are handled by a partial minimum and a join that AQE may split; it ends
    when a round changes nothing. Empty edges give an empty table; self-loops and repeats do no harm.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    was = _digest(now)
    if was[0] <= one_task:
        return _in_one_task(now)
    for _ in range(most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node keeps its smallest neighbour, and larger neighbours go to that one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        then = written(small, "edges")
        is_now = _digest(then)
        drop(now)
        now = then
        if is_now == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return out.unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
