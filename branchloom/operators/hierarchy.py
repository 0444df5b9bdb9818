"""Parent-child links of unknown depth: paths, depths, roots, descendants and circles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchloom.plans import skew
from branchloom.plans.lineage import materialize, release, rows_of, rows_with

#: While a level holds at least this share of the edges not yet placed, the next one is joined; below it the rest is deep
#: and thin, and is shortened by doubling instead.
LEVEL_SHARE = 0.125


def resolve_hierarchy(df: DataFrame, node: str, parent: str, with_path: bool = True, hot_rows: int = skew.HOT_ROWS, salts: int = skew.SALTS, level_share: float = LEVEL_SHARE) -> DataFrame:
    """Every distinct node as node_id, parent_id, root_id, depth and, if asked for, path.

    Roots are nodes whose parent is null or is no node. From them, level-wise
    frontier joins carry root, depth and path downwards, one level a job, over
    the edges not yet placed: they are written anew whenever half of them are.
    Once a level holds less than ``level_share`` of them, the chains that are
    left hang from the last frontier; doubling their links takes the logarithm
    of their length in rounds, over those few edges only. Nodes that nothing
    reaches lie on or below a circle: they get depth -1, as root the smallest
    node id of their circle, and a null path.

    ``path`` is an array from the root to the node. Parents with more than
    ``hot_rows`` children are spread over ``salts``.

    Defined results: rows with a null node are ignored; a node given several
    parents keeps the smallest one that isn't null; a node that is its own
    parent is a circle of one; no rows give no rows. Further columns are
    ignored. ids are compared as they are; normalise them before.
    """
    links = df.select(F.col(f"`{node}`").alias("id"), F.col(f"`{parent}`").alias("up")).filter("id IS NOT NULL").groupBy("id").agg(F.min("up").alias("up"))
    links = materialize(links, "links")
    known = links.select(F.col("id").alias("known"))
    placed = materialize(skew.salted_join(links, known, "up", "known", "left", hot_rows, salts, spread="id").select("id", "up", F.col("known").isNotNull().alias("has_parent")), "placed")
    release(links)

    extra = ["path"] if with_path else []
    edges = placed.filter("has_parent").select("id", "up")
    hot = skew.hot_keys(edges, ["up"], hot_rows) if rows_of(placed) > hot_rows else None
    small = None
    if hot is not None:
        small = F.broadcast(hot.select(F.col("up").alias("_hk"), F.lit(True).alias("_hot")))
        edges = edges.join(small, F.col("up") == F.col("_hk"), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0)).drop("_hk", "_hot")

    def below(edges: DataFrame, front: DataFrame) -> DataFrame:
        f = front.select(F.col("id").alias("_f"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
        on = F.col("up") == F.col("_f")
        if small is not None:
            f = f.join(small, F.col("_f") == F.col("_hk"), "left").withColumn("_fsalt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hk", "_hot")
            on = on & (F.col("_salt") == F.col("_fsalt"))
        return edges.join(f, on).select("id", "up", F.col("_root").alias("root"), (F.col("_depth") + 1).alias("depth"), *([F.concat("_path", F.array("id")).alias("path")] if with_path else []))

    front = placed.filter("NOT has_parent").select("id", "up", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"), *([F.array("id").alias("path")] if with_path else []))
    levels = [front]
    rest, written, dropped = edges.count(), None, []
    size = rest
    while rest:
        front = materialize(below(edges, front), "level")
        n = rows_of(front)
        if n == 0:
            break
        levels.append(front)
        dropped.append(front)
        rest -= n
        thin = n < level_share * rest
        if thin or rest < size / 2:
            gone = dropped[0].select(F.col("id").alias("_g"))
            for d in dropped[1:]:
                gone = gone.unionByName(d.select(F.col("id").alias("_g")))
            edges = materialize(edges.join(gone, F.col("id") == F.col("_g"), "left_anti"), "edges")
            if written is not None:
                release(written)
            written, size, dropped = edges, rest, []
        if thin:
            break
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    lost = None
    if rest:
        for d in dropped:
            edges = edges.join(d.select(F.col("id").alias("_g")), F.col("id") == F.col("_g"), "left_anti")
        left = edges.select("id", "up")
        left._branchloom_rows = rest
        tail, lost = _chains(left, levels[-1], with_path, hot_rows, salts)
        reached = reached.unionByName(tail)
    out = reached.select(F.col("id").alias("node_id"), F.col("up").alias("parent_id"), F.col("root").alias("root_id"), "depth", *extra)
    circles = circle_roots(lost, hot_rows, salts) if lost is not None else None
    if circles is None:
        return out
    more = circles.select(F.col("id").alias("node_id"), F.col("up").alias("parent_id"), F.col("root").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), *([F.lit(None).cast(out.schema["path"].dataType).alias("path")] if with_path else []))
    return out.unionByName(more)


def _chains(edges: DataFrame, front: DataFrame, with_path: bool, hot_rows: int, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """Place all of ``edges`` that hang below ``front`` by doubling their links; also the edges that don't.

    After k rounds a link spans 2^k edges or ends in the frontier. A depth
    below the frontier that some node has is had by its ancestors' depths too,
    so once a round ends no further link, those left open never end.
    """
    part = ["part"] if with_path else []
    at = front.select(F.col("id").alias("_a")).distinct()
    link = skew.salted_join(edges, at, "up", "_a", "left", hot_rows, salts, spread="id").select("id", "up", F.col("up").alias("to"), F.lit(1).cast("bigint").alias("hops"), F.col("_a").isNotNull().alias("done"), *([F.array("id").alias("part")] if with_path else []))
    link = materialize(link, "chain", F.expr("NOT done"))
    open_ = None
    while rows_with(link) and rows_with(link) != open_:
        open_ = rows_with(link)
        step = link.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("done").alias("_done"), *([F.col("part").alias("_part")] if with_path else []))
        moving = link.filter("NOT done")
        moving._branchloom_rows = open_
        moved = skew.salted_join(moving, step, "to", "_i", "inner", hot_rows, salts, spread="id").select("id", "up", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"), *([F.concat("_part", "part").alias("part")] if with_path else []))
        after = materialize(moved.unionByName(link.filter("done")), "chain", F.expr("NOT done"))
        release(link)
        link = after
    done = link.filter("done")
    done._branchloom_rows = rows_of(link)
    ends = front.select(F.col("id").alias("_e"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
    placed = skew.salted_join(done, ends, "to", "_e", "inner", hot_rows, salts, spread="id").select("id", "up", F.col("_root").alias("root"), (F.col("_depth") + F.col("hops")).alias("depth"), *([F.concat("_path", "part").alias("path")] if with_path else []))
    return placed, materialize(link.filter("NOT done"), "lost") if rows_with(link) else None


def circle_roots(lost: DataFrame, hot_rows: int = skew.HOT_ROWS, salts: int = skew.SALTS) -> DataFrame:
    """``id``, ``up``, ``root`` for links (id, up, to) whose ancestors all have a parent; ``to`` is some ancestor, the same number of steps away for all. root is the smallest id of the circle above.

    Following parents is done by doubling. Once the set of places reached
    stops shrinking, it is exactly the nodes on circles. The minimum of each
    circle is doubled likewise, until no minimum falls any more: then every
    stretch of a circle has the same one.
    """
    n = rows_of(lost)

    def jump(d: DataFrame, label: str, low: bool) -> DataFrame:
        r = d.select(F.col("id").alias("_i"), F.col("to").alias("_to"), *([F.col("low").alias("_low")] if low else []))
        j = skew.salted_join(d, r, "to", "_i", "inner", hot_rows, salts, spread="id")
        return materialize(j.select("id", F.col("_to").alias("to"), *([F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell")] if low else [])), label, F.col("fell") if low else None)

    at, places = lost, 0
    for _ in range(max(1, math.ceil(math.log2(n)) + 1)):
        now = at.agg(F.count_distinct("to")).first()[0]
        if now == places:
            break
        places = now
        at = jump(at, "landing", False)
    on_circle = at.select(F.col("to").alias("_c")).distinct()
    ring = materialize(lost.join(on_circle, F.col("id") == F.col("_c"), "left_semi").select("id", F.col("up").alias("to"), F.col("id").alias("low")), "ring")
    for _ in range(max(1, math.ceil(math.log2(max(2, places))))):
        after = jump(ring, "ring", True)
        release(ring)
        ring = after
        if not rows_with(ring):
            break
    low = ring.select(F.col("id").alias("_ring"), F.col("low").alias("root"))
    landed = skew.salted_join(at, low, "to", "_ring", "inner", hot_rows, salts, spread="id").select(F.col("id").alias("_id"), "root")
    return lost.join(landed, F.col("id") == F.col("_id")).select("id", "up", "root")


def descendants(resolved: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Ancestor pairs of a resolved hierarchy with paths: ``scope`` columns, ancestor_id, descendant_id, distance (1 and more). Nodes on or below circles have none."""
    scope = scope or []
    pairs = resolved.filter("path IS NOT NULL").select(*scope, F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("place", "ancestor_id"))
    return pairs.filter("place < depth").select(*scope, "ancestor_id", "descendant_id", (F.col("depth") - F.col("place")).alias("distance"))
