"""Pairwise matches consolidated into groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchloom.plans import skew
from branchloom.plans.lineage import materialize, release

#: Edges one task joins; a level has as many partitions as its edges need at this size.
EDGES_PER_TASK = 200_000


def local_forest(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """Union-find over the edges a-b: every node that isn't its component's smallest, with the smallest.

    A star per component: a spanning forest of the edges given.
    """
    names = pc.unique(pa.chunked_array(a.chunks + b.chunks, type=a.type))
    names = names.take(pc.sort_indices(names))  # codes in character order, so the smallest code is the smallest id
    x = pc.index_in(a, names).to_numpy()
    y = pc.index_in(b, names).to_numpy()
    parent = np.arange(len(names), dtype=np.int64)
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, high, low)  # hook every root to its smallest neighbour
        while True:  # find: compress paths fully
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    child = np.flatnonzero(parent != np.arange(len(names)))
    return names.take(pa.array(child)), names.take(pa.array(parent[child]))


def _forest(bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning forests of a partition's edges. What is held is shrunk to its forest at ``bound`` edges and handed on once the forest alone fills half of that, so memory doesn't follow the partition's size."""
    names = ["node", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def shrink() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays(list(local_forest(t.column(0), t.column(1))), names=names)

        def give(stars: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(0, stars.num_rows, 50_000):
                yield stars.slice(i, 50_000)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.RecordBatch.from_arrays(b.columns, names=names))
            n += b.num_rows
            if n > bound:
                stars = shrink()
                if stars.num_rows > bound // 2:
                    yield from give(stars)
                    held, n = [], 0
                else:
                    held, n = [stars], stars.num_rows
        if held:
            yield from give(shrink())

    return run


def connected_components(edges: DataFrame, left: str, right: str, edges_per_task: int = EDGES_PER_TASK, hot_rows: int = skew.HOT_ROWS, trace: list | None = None) -> DataFrame:
    """node and root for every node of a component of two or more; root is the component's smallest id.

    Union-find runs inside each partition of the edges and keeps only a
    spanning forest, as stars. Forests are then merged in levels. A level
    spreads the edges it got evenly over partitions of ``edges_per_task`` and
    joins each partition's edges by union-find. A node that got several roots
    ties them to the smallest of them; the node itself, and every root tied to
    a smaller one, is settled on the root it leads to and set aside. Only what
    ties roots still open goes on as the edges of the next level. At least half
    of a level's nodes are settled, so levels shrink until one partition holds
    what is left; its forest is final. The nodes set aside get their groups
    by joins from the last level back to the first. No task ever
    holds more than its share, whatever the number of edges, one node's edges
    or one component's nodes.

    ``trace``, if given, collects (edges, partitions) of every level.

    Defined results: edges with a null end tie nothing, an edge of a node with
    itself neither; repeated edges and both directions are one; no edges give
    no rows. Other columns are ignored.
    """
    pairs = edges.select(F.col(f"`{left}`").cast("string").alias("node"), F.col(f"`{right}`").cast("string").alias("root")).filter("node IS NOT NULL AND root IS NOT NULL AND node <> root")
    level = materialize(pairs.mapInArrow(_forest(edges_per_task), "node string, root string"), "forest")
    aside: list[DataFrame] = []
    while True:
        n = level.count()
        parts = max(1, -(-n // edges_per_task))
        if trace is not None:
            trace.append((n, parts))
        merged = materialize(level.repartition(parts, "node", "root").mapInArrow(_forest(edges_per_task if parts > 1 else 2 * n + 1), "node string, root string"), "forest")
        release(level)
        if parts == 1:
            break
        settled, level = _settle(merged, hot_rows)
        aside.append(settled)
        release(merged)
    stars = merged
    while aside:
        settled = aside.pop()
        final = stars.select(F.col("node").alias("_s"), F.col("root").alias("_final"))
        back = skew.salted_join(settled, final, "root", "_s", "left", hot_rows, spread="node").select("node", F.coalesce("_final", "root").alias("root"))
        stars = materialize(back.unionByName(stars), "groups")
    return stars.select("node", "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _settle(stars: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """One level: (node, root) of the nodes settled on a root that is still open, and the edges left between open roots."""
    low = stars.withColumn("low", F.min("root").over(Window.partitionBy("node")))  # a node has one row a partition at most
    low = materialize(low, "low")
    own = low.select("node", F.col("low").alias("to"), F.lit(0).alias("kind")).distinct()
    tied = low.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("to")).filter("to < node").withColumn("kind", F.lit(1))
    # a node leads to its smallest root; a root that is no node anywhere leads to the smallest root it is tied to
    lead = own.unionByName(tied).groupBy("node").agg(F.min_by("to", "kind").alias("to"))
    lead = materialize(lead, "lead")
    done, pending = [], lead
    while True:  # all leads fall, so following them by doubling ends; those that reached an open root drop out
        step = lead.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        jumped = materialize(skew.salted_join(pending, step, "to", "_n", "left", hot_rows, spread="node").select("node", F.coalesce("_to", "to").alias("to"), F.col("_to").isNull().alias("open")), "jumped")
        if pending is not lead:
            release(pending)
        done.append(jumped.filter("open").select("node", "to"))
        pending = materialize(jumped.filter("NOT open").select("node", "to"), "pending")
        if pending.isEmpty():
            break
        lead_next = materialize(jumped.select("node", "to").unionByName(lead.join(jumped.select(F.col("node").alias("_j")), F.col("node") == F.col("_j"), "left_anti")), "lead")
        release(lead)
        lead = lead_next
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    settled = materialize(settled.select("node", F.col("to").alias("root")), "settled")
    at = settled.select(F.col("node").alias("_n"), F.col("root").alias("_at"))
    left = low.filter("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
    for end in ("node", "root"):
        other = "root" if end == "node" else "node"
        left = skew.salted_join(left, at, end, "_n", "left", hot_rows, spread=other).select(F.coalesce("_at", end).alias(end), other)
    left = materialize(left.filter("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "between")
    return settled, left
