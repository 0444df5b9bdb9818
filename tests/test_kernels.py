"""Kernels against exhaustive enumeration."""

import itertools
import random
from functools import lru_cache

import numpy as np

from branchloom.operators.kernels import EXTEND, MATCH, MISMATCH, OPEN, affine_global, best_chain, expm, pruning_loglik
from branchloom.operators.trees import RATES, Topology, grid_loglik, two_state_loglik


def brute_alignment(a, b):
    @lru_cache(None)
    def go(i, j, gap):
        if i == len(a) and j == len(b):
            return 0
        out = []
        if i < len(a) and j < len(b):
            out.append((0 if "N" in (a[i], b[j]) else MATCH if a[i] == b[j] else MISMATCH) + go(i + 1, j + 1, ""))
        if i < len(a):
            out.append((EXTEND if gap == "a" else OPEN) + go(i + 1, j, "a"))
        if j < len(b):
            out.append((EXTEND if gap == "b" else OPEN) + go(i, j + 1, "b"))
        return max(out)

    return go(0, 0, "")


def test_affine_alignment():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("ACGTN") for _ in range(r.randrange(8))) for _ in range(2))
        assert affine_global(a, b) == brute_alignment(a, b), (a, b)
    assert affine_global("A" * 600, "C" * 600) is None


def test_chains():
    r = random.Random(6)
    for _ in range(80):
        n = r.randrange(1, 8)
        x, y = (np.array([r.randrange(6) for _ in range(n)]) for _ in range(2))
        s = np.array([r.choice([0.5, 1.0, 1.5, 2.0]) for _ in range(n)])
        chains = []
        for k in range(1, n + 1):
            for c in itertools.combinations(range(n), k):
                c = sorted(c, key=lambda i: (x[i], y[i]))
                if all(x[p] < x[q] and y[p] < y[q] for p, q in zip(c, c[1:])):
                    chains.append((s[list(c)].sum(), set(c)))
        top = max(t for t, _ in chains)
        scheme, delta = r.choice([("", 0.0), ("nt_x", 4.0)])
        near = [c for t, c in chains if t >= top - delta - 1e-9]
        best, kept, must = best_chain(x, y, s, scheme)
        assert best == top
        assert set(np.flatnonzero(kept)) == set().union(*near)
        assert set(np.flatnonzero(must)) == set.intersection(*near)


def test_k_state_pruning():
    q = np.array([[-0.5, 0.3, 0.2], [0.1, -0.4, 0.3], [0.0, 0.0, 0.0]])
    assert np.allclose(expm(q * 50)[:, 2], 1, atol=1e-3) and np.allclose(expm(q * 3).sum(1), 1)
    parent, length = np.array([2, 2, 4, 4, -1]), np.array([0.5, 0.6, 0.4, 0.7, 0.0])
    root = np.array([0.2, 0.5, 0.3])
    for tips in itertools.product([0, 1, 2, None], repeat=3):
        want, total = dict(zip((0, 1, 3), tips)), 0.0
        for s in itertools.product(range(3), repeat=5):
            if all(v is None or s[i] == v for i, v in want.items()):
                p = root[s[4]]
                for i in range(4):
                    p *= expm(q * length[i])[s[parent[i]], s[i]]
                total += p
        assert np.isclose(pruning_loglik(parent, length, want, q, root), np.log(total) if total > 0 else -np.inf)


def test_rate_grid_equals_single_rates():
    tree = Topology([("r", None, 0.0), ("x", "r", 0.4), ("a", "x", 0.5), ("b", "x", None), ("c", "r", 0.0)])
    gain, loss = np.array(RATES), np.array(RATES[::-1])
    for tips in itertools.product([0, 1, None], repeat=3):
        states = dict(zip("abc", tips))
        assert np.allclose(grid_loglik(tree, states, gain, loss), [two_state_loglik(tree, states, g, x) for g, x in zip(gain, loss)])
