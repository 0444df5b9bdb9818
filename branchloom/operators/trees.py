"""Rooted trees: traversal orders, distances, common ancestors, pruning, parsimony and two-state Markov likelihoods.

A tree is given as a resolved hierarchy (operators.hierarchy) with one row per
node. Trees are small against the sites on them, so a tree travels to the
sites, not the sites to the tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lifted(resolved: DataFrame, lengths: DataFrame) -> DataFrame:
    """node_id, ancestor_id, ancestor_depth, and the distance to it along the path; every node is its own ancestor at 0.

    ``lengths`` has node and length. If any node below a root has none, every edge counts as 1.
    """
    steps = resolved.filter("path IS NOT NULL").select("node_id", "depth", "root_id", F.posexplode("path").alias("ancestor_depth", "ancestor_id"))
    below = resolved.filter("depth > 0").select("node_id")
    gaps = below.join(lengths.select(F.col("node").alias("node_id"), "length"), "node_id").agg(F.coalesce(F.bool_or(F.col("length").isNull()), F.lit(False)).alias("_unit"))
    given = lengths.crossJoin(F.broadcast(gaps))  # one row
    with_length = steps.join(given.select(F.col("node").alias("ancestor_id"), F.when(F.col("_unit"), 1.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("length")), "ancestor_id", "left")
    w = Window.partitionBy("node_id").orderBy(F.desc("ancestor_depth")).rowsBetween(Window.unboundedPreceding, -1)
    return with_length.withColumn("distance", F.coalesce(F.sum("length").over(w), F.lit(0.0))).drop("length")


def tip_distances(lifted_: DataFrame, tips: DataFrame) -> DataFrame:
    """left_tip, right_tip, mrca and patristic distance for tips of one root, left < right; tips are a bounded set (the species)."""
    t = lifted_.join(tips.select(F.col("tip").alias("node_id")), "node_id")
    a = t.select(F.col("node_id").alias("left_tip"), "ancestor_id", "ancestor_depth", F.col("distance").alias("dl"))
    b = t.select(F.col("node_id").alias("right_tip"), F.col("ancestor_id").alias("_a"), F.col("distance").alias("dr"))
    pairs = a.join(b, (F.col("ancestor_id") == F.col("_a")) & (F.col("left_tip") < F.col("right_tip")))
    best = pairs.groupBy("left_tip", "right_tip").agg(F.max(F.struct("ancestor_depth", "ancestor_id", (F.col("dl") + F.col("dr")).alias("d"))).alias("m"))
    return best.select("left_tip", "right_tip", F.col("m.ancestor_id").alias("mrca"), F.col("m.d").alias("distance"))


def mrca(lifted_: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Deepest common ancestor of each group's members (group, node_id): group, mrca, depth. Groups over several roots have none."""
    size = members.groupBy(group).agg(F.count_distinct("node_id").alias("_size"))
    hits = members.distinct().join(lifted_, "node_id").groupBy(group, "ancestor_id", "ancestor_depth").agg(F.count_distinct("node_id").alias("_n"))
    return hits.join(size, group).filter("_n = _size").groupBy(group).agg(F.max(F.struct("ancestor_depth", "ancestor_id")).alias("m")).select(group, F.col("m.ancestor_id").alias("mrca"), F.col("m.ancestor_depth").alias("depth"))


class Topology:
    """Arrays of one tree in an order in which children come before parents."""

    def __init__(self, nodes: list[tuple[str, str | None, float]]):
        up = {n: p for n, p, _ in nodes}
        depth: dict[str, int] = {}
        for n in up:
            chain = []
            while n is not None and n in up and n not in depth:
                chain.append(n)
                n = up[n]
            base = depth[n] if n in depth else -1
            for i, x in enumerate(reversed(chain)):
                depth[x] = base + 1 + i
        self.order = sorted(up, key=lambda n: (-depth[n], n))
        at = {n: i for i, n in enumerate(self.order)}
        self.at = at
        self.parent = np.array([at.get(up[n], -1) for n in self.order])
        self.length = np.array([x if x is not None else 1.0 for _, _, x in sorted(nodes, key=lambda v: at[v[0]])])
        inner = set(self.parent.tolist())
        self.tips = [n for n in self.order if at[n] not in inner]


def sankoff(tree: Topology, tip_states: dict[str, int], cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Least total cost of state changes, and of each root state; tips without a state are free."""
    k = len(cost)
    table = np.zeros((len(tree.order), k))
    for tip in tree.tips:
        s = tip_states.get(tip)
        if s is not None:
            table[tree.at[tip]] = np.where(np.arange(k) == s, 0.0, np.inf)
    for i, p in enumerate(tree.parent):
        if p >= 0:
            table[p] += (cost + table[i][None, :]).min(axis=1)
    root = table[len(tree.order) - 1]
    return float(root.min()), root


@dataclass
class Parsimony:
    """Arrays over patterns: ``cost`` (n), ``states`` (n, nodes, 2) and ``pairs`` (n, nodes, 2, 2: parent, child) of optimal histories, and one such history (n, nodes)."""

    cost: np.ndarray
    states: np.ndarray
    pairs: np.ndarray
    history: np.ndarray


def equal_cost_parsimony(tree: Topology, tips: np.ndarray) -> Parsimony:
    """Two-state parsimony of many patterns at once. ``tips`` is (n, tips of the tree): 0, 1 or -1 for a tip that says nothing.

    Inside and outside costs give the states and endpoint pairs that occur in
    some optimal history. The history chosen starts at the lowest root state
    and keeps the parent's state wherever that stays optimal.
    """
    n, m = len(tips), len(tree.order)
    own = np.zeros((n, m, 2))
    for j, tip in enumerate(tree.tips):
        for s in (0, 1):
            own[tips[:, j] == 1 - s, tree.at[tip], s] = np.inf
    inside = own.copy()
    change = 1.0 - np.eye(2)
    up = np.zeros((n, m, 2))  # cheapest cost of a node's subtree for each state of its parent
    for i, p in enumerate(tree.parent):
        if p >= 0:
            up[:, i] = (inside[:, i, None, :] + change).min(axis=2)
            inside[:, p] += up[:, i]
    best = inside[:, m - 1].min(axis=1)
    pairs = np.zeros((n, m, 2, 2), dtype=bool)
    total = inside[:, m - 1].copy()
    full = np.empty((n, m, 2))  # cost of the whole tree with the node in each state
    full[:, m - 1] = total
    for i in range(m - 2, -1, -1):
        p = tree.parent[i]
        if p < 0:
            full[:, i] = inside[:, i]
            continue
        rest = full[:, p] - up[:, i]  # the tree without this subtree, by the parent's state
        rest = np.where(np.isfinite(full[:, p]), rest, np.inf)
        joint = rest[:, :, None] + change + inside[:, i, None, :]
        pairs[:, i] = joint <= best[:, None, None] + 1e-9
        full[:, i] = joint.min(axis=1)
    states = full <= best[:, None, None] + 1e-9
    history = np.zeros((n, m), dtype=int)
    history[:, m - 1] = np.where(states[:, m - 1, 0], 0, 1)
    rows = np.arange(n)
    for i in range(m - 2, -1, -1):
        p = tree.parent[i]
        if p >= 0:
            kept = history[:, p]
            history[:, i] = np.where(pairs[rows, i, kept, kept], kept, np.where(pairs[rows, i, kept, 0], 0, 1))
    return Parsimony(best, states, pairs, history)


def two_state_posteriors(tree: Topology, tips: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood (n), probability of state 1 at every node (n, nodes) and log probability that all informative tips agree, for many patterns with their own rates.

    Root frequencies are stationary. Messages are scaled at every node.
    """
    n, m = len(tips), len(tree.order)
    total = gain + loss
    prior = np.stack([loss, gain], axis=1) / total[:, None]
    moves = {}
    for i, p in enumerate(tree.parent):
        if p >= 0:
            c = -np.expm1(-total * tree.length[i]) / total
            moves[i] = np.stack([np.stack([1 - gain * c, gain * c], 1), np.stack([loss * c, 1 - loss * c], 1)], 1)

    def inward(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        like, up, scale = np.ones((n, m, 2)), np.ones((n, m, 2)), np.zeros(n)
        for j, tip in enumerate(tree.tips):
            for s in (0, 1):
                like[t[:, j] == 1 - s, tree.at[tip], s] = 0.0
        for i, p in enumerate(tree.parent):
            if p >= 0:
                top = np.maximum(like[:, i].max(axis=1), 1e-300)
                like[:, i] /= top[:, None]
                scale += np.log(top)
                up[:, i] = np.einsum("nab,nb->na", moves[i], like[:, i])
                like[:, p] *= up[:, i]
        return like, up, scale

    like, up, scale = inward(tips)
    loglik = np.log(np.maximum((prior * like[:, m - 1]).sum(axis=1), 1e-300)) + scale
    post = np.zeros((n, m, 2))
    down = np.zeros((n, m, 2))
    down[:, m - 1] = prior
    for i in range(m - 1, -1, -1):
        p = tree.parent[i]
        if p >= 0:
            others = np.ones((n, 2))
            for k in np.flatnonzero(tree.parent == p):
                if k != i:
                    others *= up[:, k]
            down[:, i] = np.einsum("na,nab->nb", down[:, p] * others, moves[i])
            down[:, i] /= np.maximum(down[:, i].sum(axis=1, keepdims=True), 1e-300)
        post[:, i] = down[:, i] * like[:, i]
    shown = post[:, :, 1] / np.maximum(post.sum(axis=2), 1e-300)
    same = []
    for s in (0, 1):
        l, _, sc = inward(np.where(tips < 0, -1, s))
        same.append(np.log(np.maximum((prior * l[:, m - 1]).sum(axis=1), 1e-300)) + sc)
    return loglik, shown, np.logaddexp(*same)


def transition(gain: float, loss: float, t: float) -> np.ndarray:
    """Two-state transition probabilities after time t."""
    total = gain + loss
    if total <= 0:
        return np.eye(2)
    c = -math.expm1(-total * t) / total
    return np.array([[1 - gain * c, gain * c], [loss * c, 1 - loss * c]])


def two_state_loglik(tree: Topology, tip_states: dict[str, int], gain: float, loss: float) -> float:
    """Log likelihood of tip states under stationary root frequencies; tips without a state are summed over."""
    like = np.ones((len(tree.order), 2))
    for tip in tree.tips:
        s = tip_states.get(tip)
        if s is not None:
            like[tree.at[tip]] = np.where(np.arange(2) == s, 1.0, 0.0)
    scale = 0.0
    for i, p in enumerate(tree.parent):
        if p >= 0:
            m = like[i].max()
            if m < 1e-100:
                like[i] /= m
                scale += math.log(m)
            like[p] *= transition(gain, loss, tree.length[i]) @ like[i]
    total = gain + loss
    root = np.array([loss, gain]) / total if total > 0 else np.array([0.5, 0.5])
    return math.log(float(root @ like[-1])) + scale


#: Rates inside the grid that the fit starts from.
RATES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.25, 1.5)
#: Bounds of every fitted rate.
RATE_MIN, RATE_MAX = 1e-8, 100.0
#: The grid that the fit starts from: RATES, and two rates a decade between the bounds.
START_RATES = tuple(sorted({*RATES, *np.geomspace(RATE_MIN, RATE_MAX, 21).round(10).tolist()}))
#: Best local maxima of the grid that are refined.
STARTS = 6
#: A start has converged if no step raises its log likelihood by more than this.
GAIN_TOL = 1e-10


def grid_loglik(tree: Topology, tip_states: dict[str, int], gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """two_state_loglik for many positive rate pairs at once: one pass over the tree, arrays over the rates."""
    total = gain + loss
    like = np.ones((len(tree.order), len(gain), 2))
    for tip in tree.tips:
        s = tip_states.get(tip)
        if s is not None:
            like[tree.at[tip]] = np.where(np.arange(2) == s, 1.0, 0.0)
    scale = np.zeros(len(gain))
    for i, p in enumerate(tree.parent):
        if p >= 0:
            top = np.maximum(like[i].max(axis=1), 1e-300)
            x = like[i] / top[:, None]
            scale += np.log(top)
            c = -np.expm1(-total * tree.length[i]) / total
            like[p, :, 0] *= (1 - gain * c) * x[:, 0] + gain * c * x[:, 1]
            like[p, :, 1] *= loss * c * x[:, 0] + (1 - loss * c) * x[:, 1]
    return np.log((loss * like[-1, :, 0] + gain * like[-1, :, 1]) / total) + scale


def refine(f, starts: np.ndarray, max_rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximise ``f`` (an array of points to values) within the rate bounds from every start: points, values, converged.

    Points are log rates. Damped Newton steps with numeric derivatives, taken
    for all starts at once; coordinates that press against a bound stay on it,
    and the bounds themselves are tried in every round, so that no fit creeps towards one.
    """
    low, high, h = math.log(RATE_MIN), math.log(RATE_MAX), 1e-4
    x = np.clip(np.asarray(starts, dtype=float), low, high)
    k, unit = x.shape[1], np.eye(x.shape[1])
    value, done = f(x), np.zeros(len(x), dtype=bool)
    damping = 10.0 ** np.arange(-6, 7)
    for _ in range(max_rounds):
        todo = np.flatnonzero(~done)
        if len(todo) == 0:
            break
        at = x[todo]
        moves = np.concatenate([unit, -unit, *[(a * unit[i] + b * unit[j])[None] for i in range(k) for j in range(i) for a in (1, -1) for b in (1, -1)]]) * h
        around = f((at[:, None, :] + moves[None]).reshape(-1, k)).reshape(len(todo), -1)
        slope = (around[:, :k] - around[:, k : 2 * k]) / (2 * h)
        bend = np.zeros((len(todo), k, k))
        for i in range(k):
            bend[:, i, i] = (around[:, i] + around[:, k + i] - 2 * value[todo]) / h**2
        place = 2 * k
        for i in range(k):
            for j in range(i):
                pp, pm, mp, mm = around[:, place : place + 4].T
                bend[:, i, j] = bend[:, j, i] = (pp - pm - mp + mm) / (4 * h**2)
                place += 4
        free = ~(((at <= low) & (slope < 0)) | ((at >= high) & (slope > 0)))
        slope = np.where(free, slope, 0.0)
        bend = np.where(free[:, :, None] & free[:, None, :], bend, 0.0)
        w, v = np.linalg.eigh(-bend)
        along = np.einsum("nji,nj->ni", v, slope)
        steps = np.einsum("nij,ndj->ndi", v, along[:, None, :] / (np.abs(w)[:, None, :] + damping[None, :, None]))
        ends = np.repeat(at[:, None, :], 2 * k, axis=1)
        for i in range(k):
            ends[:, 2 * i, i], ends[:, 2 * i + 1, i] = low, high
        tried = np.concatenate([np.clip(at[:, None, :] + np.clip(steps, -4.0, 4.0), low, high), ends], axis=1)
        reached = f(tried.reshape(-1, k)).reshape(len(todo), -1)
        best = reached.argmax(axis=1)
        rows = np.arange(len(todo))
        better = reached[rows, best] > value[todo]
        done[todo] = ~(reached[rows, best] > value[todo] + GAIN_TOL)
        x[todo[better]], value[todo[better]] = tried[rows, best][better], reached[rows, best][better]
    return x, value, done


def _best(f, starts: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """The best refined point; of equal values the one with the smallest rates."""
    x, value, done = refine(f, starts)
    top = np.flatnonzero(value >= value.max() - 1e-9)
    at = min(top, key=lambda i: tuple(np.round(x[i], 6)))
    return x[at], float(value[at]), bool(done[at])


def fit_rates(tree: Topology, tip_states: dict[str, int]) -> tuple[float, float, float, float, float, str]:
    """Maximum likelihood of one rate and of gain and loss within the bounds: er_loglik, er_rate, ard_loglik, ard_gain, ard_loss, status.

    The best local maxima of a grid are refined until no step raises the log
    likelihood. The status is `impossible` (no rates give the states: rates are
    NaN), `no_observed_contrast` (fewer than two states seen), `not_converged`,
    `boundary_limited` (a rate lies on a bound) or `success`.
    """
    r = np.log(START_RATES)
    f = lambda x: grid_loglik(tree, tip_states, np.exp(x[:, 0]), np.exp(x[:, -1]))
    n = len(r)
    with np.errstate(divide="ignore", invalid="ignore"):
        grid = f(np.stack([np.repeat(r, n), np.tile(r, n)], axis=1)).reshape(n, n)
    if not np.isfinite(grid).all():
        return -math.inf, math.nan, -math.inf, math.nan, math.nan, "impossible"
    wide = np.pad(grid, 1, constant_values=-np.inf)
    around = np.max([wide[1 + i : n + 1 + i, 1 + j : n + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
    tops = sorted(zip(*np.nonzero(grid >= around)), key=lambda ij: (-grid[ij], ij))[:STARTS]
    line = np.diag(grid)
    beside = np.maximum(np.append(line[1:], -np.inf), np.append(-np.inf, line[:-1]))
    peaks = sorted(np.flatnonzero(line >= beside), key=lambda i: (-line[i], i))[:STARTS]
    er_x, er, er_done = _best(f, r[peaks][:, None])
    ard_x, ard, ard_done = _best(f, np.concatenate([r[np.array(tops)], [[er_x[0], er_x[0]]]]))
    at_bound = np.isclose([er_x[0], *ard_x], math.log(RATE_MIN), atol=1e-5).any() or np.isclose([er_x[0], *ard_x], math.log(RATE_MAX), atol=1e-5).any()
    status = "no_observed_contrast" if len(set(tip_states[t] for t in tree.tips if tip_states.get(t) is not None)) < 2 else "not_converged" if not (er_done and ard_done) else "boundary_limited" if at_bound else "success"
    gain, loss = np.exp(ard_x)
    return er, float(np.exp(er_x[0])), ard, float(gain), float(loss), status


def fit_two_state(tree: Topology, tip_states: dict[str, int]) -> tuple[float, float, float, float]:
    """er_loglik, er_rate, ard_loglik and ard_ratio (gain / loss) of fit_rates."""
    er, rate, ard, gain, loss, _ = fit_rates(tree, tip_states)
    return er, rate, ard, gain / loss
