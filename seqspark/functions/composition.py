"""Composition statistics: residue frequencies, divergences, pseudocounts, and scaling a matrix to a pair's composition."""

from __future__ import annotations

import math

import numpy as np

from .alphabet import PROTEIN
from .matrices import BACKGROUND
from .statistics import karlin_lambda

BACK = np.array([BACKGROUND[c] for c in PROTEIN[:20]]) / sum(BACKGROUND.values())


def frequencies(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of the twenty usual residues and their number."""
    c = np.bincount(codes[codes < 20], minlength=20).astype(float)
    n = int(c.sum())
    return (c / n if n else BACK.copy()), n


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence."""
    mid = (p + q) / 2

    def kl(a):
        ok = a > 0
        return float((a[ok] * np.log(a[ok] / mid[ok])).sum())

    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def with_pseudocounts(p: np.ndarray, n: int, weight: int = 20) -> np.ndarray:
    share = weight / (n + weight)
    return (1 - share) * p + share * BACK


def high_pair(p: np.ndarray, n: int) -> bool:
    """Two residues make up over 0.4 of a sequence of over 50."""
    return n > 50 and float(np.sort(p)[-2:].sum()) > 0.4


def rule(q: np.ndarray, nq: int, s: np.ndarray, ns: int) -> str:
    """'none' if either side has no usual residue, 'scale' (keep the matrix, rescale) or 'adjust' (fit target frequencies)."""
    if nq == 0 or ns == 0:
        return "none"
    d = distance(q, s)
    dq, ds = distance(q, BACK), distance(s, BACK)
    ratio = max(nq, ns) / min(nq, ns)
    cosine = (dq * dq + ds * ds - d * d) / (2 * dq * ds) if dq and ds else 1.0
    angle = math.degrees(math.acos(max(-1.0, min(1.0, cosine))))
    if not (high_pair(q, nq) or high_pair(s, ns)) and d > 0.16 and ratio > 3 and angle > 70:
        return "scale"
    return "adjust"


def joint(m: np.ndarray, lam: float) -> np.ndarray:
    """Target frequencies that a matrix implies over the background."""
    x = BACK[:, None] * BACK[None, :] * np.exp(lam * m[:20, :20])
    return x / x.sum()


def optimal_targets(target: np.ndarray, rows: np.ndarray, cols: np.ndarray, entropy: float = 0.44, tol: float = 1e-8, rounds: int = 2000) -> np.ndarray | None:
    """The frequencies closest to target (in divergence) with given row and column sums and relative entropy; None if not found.

    The optimum has the form target^(1/(1+t)) (rows x cols)^(t/(1+t)) up to row and column factors, so for each multiplier t the sums are
    met by alternate scaling, and t follows from the entropy by bisection.
    """
    outer = rows[:, None] * cols[None, :]

    def scaled(t: float) -> np.ndarray:
        x = target ** (1 / (1 - t)) * outer ** (-t / (1 - t))
        for _ in range(rounds):
            x *= (rows / x.sum(1))[:, None]
            x *= (cols / x.sum(0))[None, :]
            if np.abs(x.sum(1) - rows).max() < tol:
                return x
        return x

    def h(x: np.ndarray) -> float:
        return float((x * np.log(x / outer)).sum())

    lo, hi = -20.0, 0.95
    if not h(scaled(lo)) <= entropy <= h(scaled(hi)):
        return None
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if h(scaled(mid)) < entropy else (lo, mid)
    x = scaled((lo + hi) / 2)
    return x if np.isfinite(x).all() else None


def adjusted(m: np.ndarray, q_codes: np.ndarray, s_codes: np.ndarray, lam: float = 0.3176, scale: int = 32) -> tuple[np.ndarray, str]:
    """(matrix in units of 1/scale for a query and a subject, rule used)."""
    q, nq = frequencies(q_codes)
    s, ns = frequencies(s_codes)
    how = rule(q, nq, s, ns)
    out = m * scale
    if how == "none":
        return out, how
    if how == "adjust":
        p, r = with_pseudocounts(q, nq), with_pseudocounts(s, ns)
        x = optimal_targets(joint(m, lam), p, r)
        if x is not None:
            return _assemble(np.log(x / (p[:, None] * r[None, :])) / (lam / scale), out, p, r), how
        how = "scale"
    low, high = int(m[:20, :20].min()), int(m[:20, :20].max())
    dist = np.zeros(high - low + 1)
    np.add.at(dist, m[:20, :20] - low, q[:, None] * s[None, :])
    own = karlin_lambda(low, dist)
    ratio = min(1.0, max(0.5, own / lam)) if not math.isnan(own) else 1.0
    return _assemble(m[:20, :20] * scale * ratio, out, q, s), how


def _assemble(core: np.ndarray, old: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Twenty by twenty scores with those of B, Z, X and U: means over their residues; X and U at most -1 each."""
    out = old.astype(float).copy()
    out[:20, :20] = core
    pairs = {"B": "DN", "Z": "EQ"}
    at = {c: i for i, c in enumerate(PROTEIN)}
    for letter, parts in pairs.items():
        k, of = at[letter], [at[c] for c in parts]
        w, v = p[of] / max(p[of].sum(), 1e-12), r[of] / max(r[of].sum(), 1e-12)
        out[k, :20], out[:20, k] = w @ core[of], core[:, of] @ v
    for letter in "XU":
        k = at[letter]
        out[k, :20], out[:20, k] = np.minimum(p @ core, -1), np.minimum(core @ r, -1)
    return np.where(out >= 0, np.floor(out + 0.5), np.ceil(out - 0.5)).astype(np.int64)
