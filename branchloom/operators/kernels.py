"""Kernels that SQL can't express: affine alignment, monotone chains, k-state Markov models."""

from __future__ import annotations

import numpy as np

# Alignment scores.
MATCH, MISMATCH, OPEN, EXTEND = 2, -3, -7, -2
#: Cells of one alignment at most; a larger pair gets the status ``too_large`` and no score.
MAX_CELLS = 250_000


def affine_global(a: str, b: str, max_cells: int | None = MAX_CELLS) -> int | None:
    """Best global score of two sequences with affine gaps (a gap of n costs OPEN + (n - 1) * EXTEND); N is neutral. None beyond ``max_cells``; without that, of any length: memory is one row."""
    n, m = len(a), len(b)
    if max_cells is not None and (n + 1) * (m + 1) > max_cells:
        return None
    low = -(10**9)
    gaps = OPEN + EXTEND * (np.arange(m + 1) - 1)
    best = np.where(np.arange(m + 1) == 0, 0, gaps).astype(np.int64)  # row 0
    down = np.full(m + 1, low, dtype=np.int64)
    codes = np.frombuffer(b.encode(), dtype=np.uint8)
    for i in range(1, n + 1):
        x = ord(a[i - 1])
        pair = np.where((codes == ord("N")) | (x == ord("N")), 0, np.where(codes == x, MATCH, MISMATCH))
        down = np.maximum(best + OPEN, down + EXTEND)
        down[0] = OPEN + EXTEND * (i - 1)
        row = np.maximum(down, np.concatenate(([low], best[:-1] + pair)))
        # gaps along the row: the best of row[k] + OPEN + (j - k - 1) * EXTEND over k < j, as a running maximum
        run = np.maximum.accumulate(row - EXTEND * np.arange(m + 1))
        across = np.concatenate(([low], run[:-1] + OPEN - EXTEND + EXTEND * np.arange(1, m + 1)))
        best = np.maximum(row, across)
    return int(best[m])


# How far below the best chain another one still counts, for nucleotide schemes.
MATCH_REWARD, RELATIVE_DELTA = 2.0, 0.05


def score_delta(best: float, scheme: str) -> float:
    """What a chain may miss of the best one: for nucleotide schemes (``nt_...``) two matches or a twentieth of the best chain, else nothing."""
    return max(2.0 * MATCH_REWARD, RELATIVE_DELTA * abs(best)) if scheme.startswith("nt_") else 0.0


def best_chain(x: np.ndarray, y: np.ndarray, score: np.ndarray, scheme: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    """Best total of a chain that rises strictly in x and y; which items lie on a chain within ``score_delta`` of it; which lie on all of those."""
    n = len(x)
    if n == 0:
        return 0.0, np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((y, x))
    x, y, s = x[order], y[order], score[order]
    ahead = np.zeros(n)
    back = np.zeros(n)
    for i in range(n):
        before = (x[:i] < x[i]) & (y[:i] < y[i])
        ahead[i] = s[i] + (ahead[:i][before].max() if before.any() and ahead[:i][before].max() > 0 else 0.0)
    for i in range(n - 1, -1, -1):
        after = (x[i + 1 :] > x[i]) & (y[i + 1 :] > y[i])
        back[i] = s[i] + (back[i + 1 :][after].max() if after.any() and back[i + 1 :][after].max() > 0 else 0.0)
    best = float(ahead.max())
    delta = score_delta(best, scheme)
    through = ahead + back - s
    tol = 1e-12 * max(1.0, abs(best))
    kept = through >= best - delta - tol
    must = np.zeros(n, bool)
    for i in np.flatnonzero(kept):  # without it, is there still a chain within delta?
        rest = np.arange(n) != i
        alt = _best_total(x[rest], y[rest], s[rest])
        must[i] = alt < best - delta - tol
    back_to = np.empty(n, dtype=int)
    back_to[order] = np.arange(n)
    return best, kept[back_to], must[back_to]


def _best_total(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> float:
    top = np.zeros(len(x))
    for i in range(len(x)):
        before = (x[:i] < x[i]) & (y[:i] < y[i])
        top[i] = s[i] + max(0.0, top[:i][before].max() if before.any() else 0.0)
    return float(top.max()) if len(x) else float("-inf")


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor series and squaring."""
    norm = np.abs(a).sum(axis=1).max() if a.size else 0.0
    k = max(0, int(np.ceil(np.log2(norm))) + 4) if norm > 0 else 0
    x = a / 2**k
    out = term = np.eye(len(a))
    for i in range(1, 14):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def pruning_loglik(parent: np.ndarray, length: np.ndarray, tips: dict[int, int | None], generator: np.ndarray, root: np.ndarray) -> float:
    """Log likelihood of tip states under a k-state model; nodes are ordered with children before parents, the root last."""
    k = len(generator)
    like = np.ones((len(parent), k))
    for i, s in tips.items():
        if s is not None:
            like[i] = np.eye(k)[s]
    for i, p in enumerate(parent):
        if p >= 0:
            like[p] *= expm(generator * length[i]) @ like[i]
    total = float(root @ like[-1])
    return float(np.log(total)) if total > 0 else float("-inf")
