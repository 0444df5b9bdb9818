"""Sources mixed to target weights of the total size."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Items of a leaf that share one bucket of an epoch's order, about.
BUCKET_ITEMS = 50_000
SEED = 17


@dataclass
class Node:
    """A node of the domain-language-source tree; only leaves have a capacity of their own."""

    name: tuple
    weight: float = 0.0
    capacity: float = 0.0
    children: dict = field(default_factory=dict)
    budget: float = 0.0


def budget_tree(leaves: list[tuple[tuple, float, float]]) -> Node:
    """Tree of (path, weight, capacity) leaves; inner nodes add up their children."""
    root = Node(())
    for path, weight, capacity in sorted(leaves):
        node = root
        node.weight, node.capacity = node.weight + weight, node.capacity + capacity
        for i in range(len(path)):
            node = node.children.setdefault(path[: i + 1], Node(path[: i + 1]))
            node.weight, node.capacity = node.weight + weight, node.capacity + capacity
    return root


def allocate(node: Node, amount: float) -> None:
    """Hand ``amount`` down by weight. What a child can't hold goes to its siblings, by weight; only what all of them can't hold goes back to the ancestors, who never hand down more than a subtree holds."""
    node.budget = min(amount, node.capacity)
    left, open_ = node.budget, [c for c in node.children.values() if c.weight > 0 and c.capacity > 0]
    given = {c.name: 0.0 for c in open_}
    while open_ and left > 1e-9:
        weight = sum(c.weight for c in open_)
        share = {c.name: left * c.weight / weight for c in open_}
        short = [c for c in open_ if given[c.name] + share[c.name] >= c.capacity - 1e-9]
        if not short:
            for c in open_:
                given[c.name] += share[c.name]
            break
        for c in short:  # saturated: the rest is shared again among the others
            left -= c.capacity - given[c.name]
            given[c.name] = c.capacity
        open_ = [c for c in open_ if c not in short]
    for c in node.children.values():
        allocate(c, given.get(c.name, 0.0))


def leaf_budgets(node: Node) -> dict[tuple, float]:
    if not node.children:
        return {node.name: node.budget}
    return {k: v for c in node.children.values() for k, v in leaf_budgets(c).items()}


def largest_even_total(leaves: list[tuple[tuple, float, float]]) -> float:
    """Largest total at which no leaf that has anything runs short."""
    probe = budget_tree([(p, w, 1e18 if c > 0 else 0.0) for p, w, c in leaves])
    allocate(probe, 1.0)
    shares = leaf_budgets(probe)
    limits = [c / shares[p] for p, w, c in leaves if c > 0 and shares[p] > 0]
    return min(limits, default=0.0)


#: Leaves of a source up to which every choice of border items is tried; beyond it the leaves are rounded one by one.
TRIED_BORDERS = 12


def choose_borders(borders: list[tuple[float, int, float]]) -> list[bool]:
    """Which border items of a source's leaves to take, given (tokens before it, its tokens, budget): the source's total comes as close to its budget as can be."""
    short = sum(rest - before for before, _, rest in borders)
    if len(borders) > TRIED_BORDERS:
        out = []
        for before, n, rest in sorted(borders, key=lambda x: -x[1]):
            out.append(((before, n, rest), abs(short - n) < abs(short)))
            short -= n * out[-1][1]
        return [next(out.pop(i)[1] for i, (y, _) in enumerate(out) if y == x) for x in borders]
    return list(min(product([False, True], repeat=len(borders)), key=lambda take: (abs(short - sum(n for (_, n, _), t in zip(borders, take) if t)), take)))


@dataclass
class Mixture:
    """``rows``: item, domain, language, source, epoch, n_tokens, one row per use. ``shares``: the report per source."""

    rows: DataFrame
    shares: DataFrame


def mix(items: DataFrame, targets: list[tuple[str, float, int]], domains: dict[str, str], total_tokens: float | None = None, seed: int = SEED, bucket_items: int = BUCKET_ITEMS) -> Mixture:
    """Choose uses of ``items`` (item, source, language, n_tokens) so that sources reach their target shares.

    ``targets`` are (source, share, max_repeats). Weights run through the tree
    domain - language - source: a source's share splits over its languages by
    the tokens there are, and sums up to languages and domains. Budgets run
    down the same tree; a shortage goes to siblings before ancestors. Without
    ``total_tokens`` the total is the largest at which no source that has
    texts runs short. A leaf takes whole epochs, each a seeded order of its
    items, and a prefix of one more epoch, up to its budget. Of the items on
    the borders of a source's leaves those are taken that bring the source's
    total closest to its budget. No item is used more than max_repeats times,
    and none is cut.

    ``domains`` names the domain of each source; a source it doesn't name
    stands in the domain with the largest weight, so that every target has
    siblings. The only data on the driver are one row per leaf (targets x
    language codes of two or three letters). Prefixes are found from bucket
    sums, so no task orders a whole leaf.

    Defined results: items without tokens or without a target source are never
    used; a source in ``targets`` without items reaches 0 and its share goes to
    its siblings; a source without a target is reported with share 0; missing
    or odd language codes are `und`; no items give no rows and shares of 0.
    """
    spark = items.sparkSession
    shares = {}
    for source, share, repeats in targets:
        if source is not None and share is not None and share > 0 and repeats and repeats > 0:
            shares[source] = (float(share), int(repeats))
    base = items.select("item", "source", F.when(F.col("language").rlike("^[a-z]{2,3}$"), F.col("language")).otherwise("und").alias("language"), F.col("n_tokens").cast("bigint").alias("n_tokens")).filter("n_tokens > 0 AND source IS NOT NULL")
    wanted = base.filter(F.col("source").isin(*shares)) if shares else base.filter(F.lit(False))
    have = {(r.source, r.language): (r.tokens, r.n) for r in wanted.groupBy("source", "language").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    per_source = {s: sum(t for (x, _), (t, _) in have.items() if x == s) for s in shares}
    weights: dict[str, float] = {}
    for s, (w, _) in shares.items():
        if s in domains:
            weights[domains[s]] = weights.get(domains[s], 0.0) + w
    largest = min(weights, key=lambda x: (-weights[x], x), default="all")
    domains = {s: domains.get(s, largest) for s in shares}
    leaves = [((domains[s], lang, s), shares[s][0] * t / per_source[s], float(t * shares[s][1])) for (s, lang), (t, _) in have.items()]
    leaves += [((domains[s], "none", s), w, 0.0) for s, (w, _) in shares.items() if not per_source[s]]
    total = largest_even_total(leaves) if total_tokens is None else float(total_tokens)
    tree = budget_tree(leaves)
    allocate(tree, total)
    budgets = leaf_budgets(tree) if leaves else {}
    plan = []
    for (domain, lang, s), budget in budgets.items():
        tokens, n = have.get((s, lang), (0, 0))
        if tokens:
            full = min(int(budget / tokens + 1e-9), shares[s][1])
            rest = budget - full * tokens if full < shares[s][1] else 0.0
            plan.append((s, lang, domain, full, max(0.0, rest), min(20, max(0, math.ceil(math.log2(max(1, n / bucket_items)))))))
    leaf = spark.createDataFrame(plan, "l_source string, l_language string, domain string, full int, rest double, bits int")
    d = wanted.join(F.broadcast(leaf), (F.col("source") == F.col("l_source")) & (F.col("language") == F.col("l_language"))).drop("l_source", "l_language")
    cols = ["item", "domain", "language", "source"]
    whole = d.filter("full > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n_tokens")
    order = d.filter("rest > 0").withColumn("place", F.xxhash64(F.lit(seed), F.col("full"), F.col("item"))).withColumn("bucket", F.expr("cast(CASE WHEN bits = 0 THEN 0 ELSE shiftright(place, 64 - bits) END AS bigint)"))
    sums = order.groupBy("source", "language", "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("b_rest"))
    along = Window.partitionBy("source", "language").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(along), F.lit(0))).filter("before <= b_rest").select(F.col("source").alias("b_source"), F.col("language").alias("b_language"), F.col("bucket").alias("b_bucket"), "before", "t")
    reached = order.join(sums, (F.col("source") == F.col("b_source")) & (F.col("language") == F.col("b_language")) & (F.col("bucket") == F.col("b_bucket")))
    inside = reached.filter("before + t <= rest")
    border = reached.filter("before + t > rest")  # one bucket of each leaf
    w = Window.partitionBy("source", "language").orderBy("place", "item").rowsBetween(Window.unboundedPreceding, -1)
    border = border.withColumn("cum", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).filter("cum < rest")
    at: dict[str, list] = {}
    for r in border.filter("cum + n_tokens > rest").select("source", "language", "cum", "n_tokens", "rest").collect():  # one row a leaf
        at.setdefault(r.source, []).append((r.language, r.cum, r.n_tokens, r.rest))
    taken = []
    for s, rows_ in at.items():
        rows_.sort()
        taken += [(s, x[0]) for x, yes in zip(rows_, choose_borders([x[1:] for x in rows_])) if yes]
    taken = spark.createDataFrame(taken, "t_source string, t_language string")
    border = border.join(F.broadcast(taken), (F.col("source") == F.col("t_source")) & (F.col("language") == F.col("t_language")), "left").filter("cum + n_tokens <= rest OR t_source IS NOT NULL")
    part = inside.select(*cols, F.col("full").alias("epoch"), "n_tokens").unionByName(border.select(*cols, F.col("full").alias("epoch"), "n_tokens"))
    rows = whole.unionByName(part)

    used = rows.groupBy(F.col("source").alias("u_source")).agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"), F.max("epoch").alias("last_epoch"))
    there = base.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    effective = {}
    for (_, _, s), b in budgets.items():
        effective[s] = effective.get(s, 0.0) + b
    goal = spark.createDataFrame([(s, domains[s], w, r, effective.get(s, 0.0)) for s, (w, r) in shares.items()], "g_source string, domain string, target_share double, max_repeats int, budget_tokens double")
    all_used = F.sum("used_tokens").over(Window.partitionBy())  # one row per source
    report = there.join(goal, F.col("source") == F.col("g_source"), "full").withColumn("source", F.coalesce("source", "g_source"))
    report = report.join(F.broadcast(used), F.col("source") == F.col("u_source"), "left").select(
        "source", "domain", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.round(F.coalesce("budget_tokens", F.lit(0.0)), 3).alias("budget_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce(F.col("last_epoch") + 1, F.lit(0)).alias("epochs"),
        F.coalesce(F.round(F.col("used_tokens") / all_used, 6), F.lit(0.0)).alias("reached_share"),
    )
    return Mixture(rows, report)
