"""Significance of local alignment scores: Karlin-Altschul parameters and finite-size e-values."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import LETTERS, PROTEIN
from .matrices import BACKGROUND

LN2 = math.log(2)


@dataclass(frozen=True)
class Gapped:
    """Fixed values for BLOSUM62, gap 11 and 1; other systems are passed as parameters."""

    lam: float = 0.267
    k: float = 0.041
    a: float = 1.9
    alpha: float = 42.6028
    sigma: float = 43.6362
    b: float = -26.6016
    beta: float = -903.31536
    tau: float = -928.11696
    log_k: float = -3.1941832122778293


DEFAULT = Gapped()


def score_distribution(query: np.ndarray, m: np.ndarray) -> tuple[int, np.ndarray]:
    """(lowest score, probabilities): a random query letter against a background letter."""
    back = np.array([BACKGROUND.get(c, 0.0) for c in PROTEIN])
    back /= back.sum()
    own = np.bincount(query[query < 20], minlength=LETTERS).astype(float)
    own = own / own.sum() if own.sum() else back
    low, high = int(m.min()), int(m.max())
    p = np.zeros(high - low + 1)
    np.add.at(p, m - low, own[:, None] * back[None, :])
    return low, p


def karlin_lambda(low: int, p: np.ndarray) -> float:
    """The positive root of sum p_s exp(lambda s) = 1; NaN unless the mean is negative and a positive score exists."""
    s = np.arange(low, low + len(p))
    if (p * s).sum() >= 0 or not p[s > 0].any():
        return math.nan
    f = lambda x: (p * np.exp(x * s)).sum() - 1
    lo, hi = 1e-6, 0.5
    while f(hi) < 0:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return (lo + hi) / 2


def karlin_h(low: int, p: np.ndarray, lam: float) -> float:
    s = np.arange(low, low + len(p))
    return lam * float((s * p * np.exp(lam * s)).sum())


def karlin_k(low: int, p: np.ndarray, lam: float, h: float, rounds: int = 100) -> float:
    """The lattice series: exp(-2 sigma) over the excursion sums of the score walk."""
    s = np.arange(low, low + len(p))
    step = int(np.gcd.reduce(np.abs(s[p > 0])))
    sigma, walk, base = 0.0, np.ones(1), 0
    for j in range(1, rounds + 1):
        walk, base = np.convolve(walk, p), base + low
        at = np.arange(base, base + len(walk))
        term = float((walk * np.where(at < 0, np.exp(np.minimum(lam * at, 0)), 1.0)).sum()) / j
        sigma += term
        if term < 1e-4:
            break
    return step * lam * math.exp(-2 * sigma) / (h * (1 - math.exp(-step * lam)))


def karlin(query: np.ndarray, m: np.ndarray) -> tuple[float, float, float]:
    """(lambda, K, H) without gaps."""
    low, p = score_distribution(query, m)
    lam = karlin_lambda(low, p)
    if math.isnan(lam):
        return math.nan, math.nan, math.nan
    h = karlin_h(low, p, lam)
    return lam, karlin_k(low, p, lam, h), h


def ungapped_trigger(lam: float, k: float, bits: float = 22.0) -> int:
    return int((bits * LN2 + math.log(k)) / lam)


def ungapped_drop(lam: float, bits: float = 7.0) -> int:
    return math.ceil(bits * LN2 / lam)


def gapped_drop(bits: float = 15.0, g: Gapped = DEFAULT) -> int:
    return math.floor(bits * LN2 / g.lam)


def evalue(score: float, m: int, n: int, letters: int, scale: float = 1.0, g: Gapped = DEFAULT) -> float:
    """Expected number of database hits at a score: the finite-size corrected form; scale: of the scores."""
    lam = g.lam / scale
    f = lam / g.lam
    a, alpha, sigma = g.a * f, g.alpha * f, g.sigma * f
    var = max(2 * alpha / lam, alpha * score + g.beta)
    sd = math.sqrt(var)

    def side(length: int) -> tuple[float, float]:
        left = length - (a * score + g.b)
        p = 0.5 + 0.5 * math.erf(left / sd)
        return left * p + sd / math.sqrt(2 * math.pi) * math.exp(-0.5 * (left / sd) ** 2), p

    (x, px), (y, py) = side(m), side(n)
    area = x * y + max(2 * sigma / lam, sigma * score + g.tau) * px * py
    return area * g.k * math.exp(-lam * score) * (letters / n if letters else 1.0)


def cutoff(limit: float, m: int, letters: int, n: int = 10, g: Gapped = DEFAULT) -> int:
    """The largest score whose e-value exceeds the limit, by bisection."""
    high = max(int(math.log((letters or 1) / limit) / g.lam), 2)
    low = 0
    while evalue(high, m, n, letters, g=g) > limit:
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if evalue(mid, m, n, letters, g=g) > limit else (low, mid)
    return low


def bit_score(score: float, scale: float = 32.0, g: Gapped = DEFAULT) -> float:
    """Bits of a score in units of 1/scale; scores are rounded to whole units first."""
    whole = math.floor(abs(score) / scale + 0.5) * (1 if score >= 0 else -1)
    return (whole * g.lam - g.log_k) / LN2


def length_adjustment(k: float, log_k: float, alpha_over_lambda: float, beta: float, m: int, n: int, count: int) -> int:
    """The largest l with K (m - l)(n - count l) > max(m, n) consistent with l = alpha/lambda ln(...) + beta, by fixed points."""
    l = 0.0
    for _ in range(20):
        space = max(1.0, (m - l) * (n - count * l))
        new = alpha_over_lambda * (log_k + math.log(space)) + beta
        new = min(max(0.0, new), m - 1, n / max(1, count) - 1)
        if abs(new - l) < 0.5:
            break
        l = new
    return int(max(0.0, l))


def evalue_text(e: float) -> str:
    """How reports print an e-value."""
    for limit, form in ((1e-180, "0.0"), (1e-99, "%2.0e"), (9e-4, "%3.0e"), (0.1, "%4.3f"), (1, "%3.2f"), (10, "%2.1f")):
        if e < limit:
            return form if "%" not in form else form % e
    return "%5.0f" % e


def bits(score: Column, scale: float = 1.0, g: Gapped = DEFAULT) -> Column:
    """``bit_score`` as an expression."""
    whole = F.floor(F.abs(score) / scale + 0.5) * F.signum(score.cast("double"))
    return (whole * g.lam - g.log_k) / LN2


def nominal(bit: Column, g: Gapped = DEFAULT) -> Column:
    """The least whole score that reaches so many bits."""
    return F.ceil((bit * LN2 + g.log_k) / g.lam - 1e-9)


def simple_evalue(bit: Column, space: Column) -> Column:
    """Expected hits of so many bits in a search space, without corrections for finite sizes."""
    return space / F.pow(F.lit(2.0), bit)


def search_space(m: Column, letters: Column, count: Column, adjustment: Column) -> Column:
    """Effective letters of a query times those of a collection of count sequences, in 64 bits (a score times 60 million letters is over 31)."""
    m, letters, count, adjustment = (x.cast("long") for x in (m, letters, count, adjustment))
    return (m - adjustment) * (letters - count * adjustment)


def evalue_string(e: Column) -> Column:
    """``evalue_text`` as an expression."""
    forms = [(1e-180, None), (1e-99, "%2.0e"), (9e-4, "%3.0e"), (0.1, "%4.3f"), (1.0, "%3.2f"), (10.0, "%2.1f")]
    out = F.when(e < forms[0][0], "0.0")
    for limit, form in forms[1:]:
        out = out.when(e < limit, F.format_string(form, e))
    return out.otherwise(F.format_string("%5.0f", e))
