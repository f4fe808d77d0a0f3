"""Table counts of Pitman-Yor restaurants: generalised Stirling numbers and exact draws from p(t) ~ S(n, t) a^t."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 1024  #: counts up to this draw from the Stirling table; larger ones from Stirling numbers by a contour integral
_U = np.linspace(-9, 9, 101)  # the contour's parameter
_NODES = np.cos(np.pi * (np.arange(15) + 0.5) / 15)
_TO_CHEBYSHEV = np.linalg.inv(np.polynomial.chebyshev.chebvander(_NODES, 14))
_GRID = 512


@lru_cache(4)
def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t) of type (-1, -d, 0), 1 <= t <= n <= ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, most):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(n - t * d, 0)) + out[n, t]
        out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


def log_coefficient(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the coefficient of x^n in (1 - (1 - x)^d)^t, which is S(n, t) d^t t! / n!; real t of 1 to n.

    Cauchy's integral with x = 1 - exp(-z), by the trapezoidal rule on a path around the cut, through the saddle point.
    """
    n, t = n[:, None], t[:, None]
    low, high = np.full(n.shape, -40.0), np.full(n.shape, 5.0)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(30):
            mid = (low + high) / 2
            above = t * d / np.expm1(d * np.exp(mid)) > (n + 1) / np.expm1(np.exp(mid))
            high, low = np.where(above, mid, high), np.where(above, low, mid)
        saddle = np.minimum(np.exp((low + high) / 2), np.log(n + 1))
        e, g = -np.expm1(-d * saddle), -np.expm1(-saddle)
        bend = (n + 1) * np.exp(-saddle) / g**2 - t * d * d * np.exp(-d * saddle) / e**2
        w = np.minimum(np.minimum(1.0, 0.2 * saddle), 3 / np.pi / np.sqrt(np.maximum(bend, 1e-300)))
    low, high = np.full(n.shape, 1e-6), np.full(n.shape, 4.0)
    for _ in range(30):  # steps of w about the saddle that grow to the path's ends: u = c sinh(b U)
        b = (low + high) / 2
        above = np.sinh(9 * b) / b > 9 / w
        high, low = np.where(above, b, high), np.where(above, low, b)
    u = w / b * np.sinh(b * _U)
    w = w * np.cosh(b * _U)
    y, turn = np.pi * np.tanh(u), np.pi / np.cosh(u) ** 2
    away = np.sqrt(saddle**2 + y**2)  # to the left at once where the saddle is near the pole at 0
    z = 2 * saddle - away - np.log(np.cosh(u)) + 1j * y
    step = w * (-np.tanh(u) - y * turn / away + 1j * turn)
    value = t * np.log(1 - np.exp(-d * z)) - (n + 1) * np.log(1 - np.exp(-z)) - z
    top = value.real.max(1, keepdims=True)
    total = (np.exp(value - top) * step).sum(1).imag * (_U[1] - _U[0]) / (2 * np.pi)
    return top[:, 0] + np.log(np.maximum(total, 1e-300))


def _log_factorial(t: np.ndarray) -> np.ndarray:
    x = t + 8.0  # Stirling's series, carried down
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - sum(np.log(t + j) for j in range(1, 8))


def _many_tables(n: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of large counts, from p(t) proportional to S(n, t) a^t, in a window of eight deviations or more about its middle."""
    low, high = np.full(len(n), -40.0), np.full(len(n), 6.0)
    for _ in range(50):  # a exp(-d z) (exp(z) - 1) = n + 1
        z = np.exp((low + high) / 2)
        above = np.log(a) + (1 - d) * z + np.log(-np.expm1(-z)) > np.log(n + 1)
        high, low = np.where(above, np.log(z), high), np.where(above, low, np.log(z))
    middle = np.minimum(-a / d * np.expm1(-d * z), n)
    reach = 8 * np.sqrt(middle + 1) + 8
    first, last = np.floor(np.maximum(1, middle - reach)), np.ceil(np.minimum(n, middle + reach))
    width = last - first
    nodes = first[:, None] + width[:, None] * (_NODES + 1) / 2
    values = log_coefficient(np.repeat(n, len(_NODES)), nodes.ravel(), d).reshape(nodes.shape)
    series = (values + _log_factorial(n[:, None] - nodes)) @ _TO_CHEBYSHEV.T  # smooth up to t = n
    cells = np.minimum(width + 1, _GRID)  # whole numbers, or as many even cells with a place drawn inside
    j = np.arange(int(cells.max()))
    at = np.where(cells < _GRID, j[None, :].T, (j[None, :].T + 0.5) * (width + 1) / _GRID - 0.5).T
    t = first[:, None] + at
    s = 2 * at / np.maximum(width, 1)[:, None] - 1
    logit = np.polynomial.chebyshev.chebval(np.clip(s, -1, 1).T, series.T, tensor=False).T + t * np.log(a / d)[:, None] - _log_factorial(t) - _log_factorial(np.maximum(n[:, None] - t, 0))
    logit[j[None, :] >= cells[:, None]] = -np.inf
    total = np.cumsum(np.exp(logit - logit.max(1, keepdims=True)), axis=1)
    k = (total < rng.random(len(n))[:, None] * total[:, -1:]).sum(1)
    inside = np.where(cells < _GRID, 0.0, (rng.random(len(n)) - 0.5) * (width + 1) / _GRID)
    return np.clip(np.rint(t[np.arange(len(n)), k] + inside), 1, n).astype(np.int64)


def draw_tables(count: np.ndarray, a: np.ndarray, d: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of ``count`` customers of a dish, each from p(t) proportional to S(count, t) a^t."""
    out = np.minimum(count, 1)
    order = np.argsort(count, kind="stable")
    cut = np.searchsorted(count[order], np.arange(2, EXACT + 2))
    log_a = np.log(np.maximum(a, 1e-300))
    for c in range(2, EXACT + 1):
        if cut[c - 2] == cut[c - 1]:
            continue
        mine = order[cut[c - 2] : cut[c - 1]]
        for k in range(0, len(mine), 1 + 400_000 // c):
            some = mine[k : k + 1 + 400_000 // c]
            logit = table[c, 1 : c + 1] + log_a[some][:, None] * np.arange(1, c + 1)
            logit -= logit.max(1, keepdims=True)
            total = np.cumsum(np.exp(logit), axis=1)
            out[some] = 1 + (total < rng.random(len(some))[:, None] * total[:, -1:]).sum(1)
    big = order[cut[-1] :]
    for k in range(0, len(big), 256):
        some = big[k : k + 256]
        out[some] = _many_tables(count[some].astype(float), np.maximum(a[some], 1e-300), d, rng)
    return out
