"""The production parameters of mixing meet the targets."""

import numpy as np
import pytest

from treeline.llm import mixing


@pytest.mark.parametrize("share", [(0.127, 0.766, 0.107), (0.01, 0.89, 0.1)])
@pytest.mark.parametrize("soft", [0.0, 0.05])
def test_targets_are_met(spark, share, soft):
    r = np.random.default_rng(9)
    own = np.eye(3)[r.choice(3, 3000, p=share)]
    p = (1 - soft) * own + soft * r.dirichlet([1, 1, 1], 3000)
    n = r.integers(20, 900, 3000)
    members = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    steps, reached, goal = mixing.solve(members, mixing.TARGETS)
    rate = mixing.rate(p, steps)
    assert (rate >= 0).all() and np.allclose((n * rate) @ p, reached)
    assert (np.abs((n * rate) @ p - n.sum() * np.array([0.05, 0.92, 0.03])) <= mixing.TOLERANCE * goal).all()


def test_unreachable_target_warns(spark):
    members = spark.createDataFrame([(10, [0.0, 1.0, 0.0]), (5, [0.0, 0.5, 0.5])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="targets not met"):
        mixing.solve(members, mixing.TARGETS)
