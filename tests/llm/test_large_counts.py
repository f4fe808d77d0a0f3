"""Table counts of large numbers of customers follow S(n, t) a^t."""

from math import lgamma

import numpy as np
import pytest

from treeline.llm import seating


@pytest.mark.parametrize("d,n,a", [(0.8, 1000, 3.0), (0.4, 2000, 30.0), (0.8, 120, 0.01), (0.6, 1500, 400.0), (0.95, 300, 20.0), (0.1, 1000, 2.0), (0.8, 200, 1e4)])
def test_law_of_large_counts(d, n, a):
    exact = seating.log_stirling(d, n)[n, 1:] + np.log(a) * np.arange(1, n + 1)
    p = np.exp(exact - exact.max())
    p /= p.sum()
    t = np.arange(1, n + 1)
    mean, spread = p @ t, np.sqrt(p @ t**2 - (p @ t) ** 2)
    m = 4000
    for draw in (lambda r: seating.draw_tables(np.full(m, n), np.full(m, a), d, seating.log_stirling(d), r), lambda r: seating._many_tables(np.full(m, float(n)), np.full(m, a), d, r)):
        check(draw(np.random.default_rng(3)), p, n, m, mean, spread)


def check(got, p, n, m, mean, spread):
    assert abs(got.mean() - mean) < 5 * spread / np.sqrt(m) + 0.01
    assert abs(got.std() - spread) < 0.08 * spread + 0.01
    assert np.abs(np.bincount(got, minlength=n + 1)[1:] / m - p).max() < 0.04


def test_very_large_counts_against_the_closed_form():
    d, n, a = 0.5, 40_000_000, 50.0  # d = 1/2: S(n, t) is known in closed form
    t = np.arange(1, 3000)
    logit = np.array([lgamma(2 * n - k) - lgamma(k) - lgamma(n - k + 1) for k in t]) + t * np.log(4 * a)
    p = np.exp(logit - logit.max())
    p /= p.sum()
    got = seating.draw_tables(np.full(2000, n), np.full(2000, a), d, seating.log_stirling(d), np.random.default_rng(3))
    assert abs(got.mean() - p @ t) < 5 * np.sqrt(p @ t**2 - (p @ t) ** 2) / np.sqrt(2000) + 0.01
