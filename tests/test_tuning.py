"""The adaptive search on known loss surfaces, without Spark."""

import math
import random
from statistics import median

import pytest

from tripwise.operators import learning as L
from tripwise.operators import tuning as T

SPACE = L.TUNING_SPACE


def surface(p):
    """A bowl with its bottom inside the space, steep along some parameters."""
    return (((p["max_depth"] - 11) / 12) ** 2 + (math.log(p["learning_rate"] / 0.04) / 3) ** 2 + ((p["num_leaves"] - 120) / 130) ** 2
            + 2 * (p["feature_fraction"] - 0.58) ** 2 + ((p["n_estimators"] - 350) / 400) ** 2 + 0.1 * ((p["min_child_samples"] - 40) / 45) ** 2)


def test_draws_and_proposals_respect_the_space():
    history = []
    for seed in range(60):
        rng = random.Random(seed)
        p = T.propose(rng, SPACE, history, [])
        history.append(T.Trial(seed, p, (surface(p),), 1))
        assert set(p) == set(SPACE)
        for name, (kind, low, high, step) in SPACE.items():
            assert low <= p[name] <= high + 1e-12
            assert kind != "step" or (p[name] - low) % step == 0


def test_density_is_a_density():
    d = T.Density([0.0, 0.02, 0.5, 1.0])
    n = 20_000
    assert sum(d((i + 0.5) / n) for i in range(n)) / n == pytest.approx(1, abs=1e-3)
    rng = random.Random(1)
    assert all(0 <= d.draw(rng) <= 1 for _ in range(1000))
    assert T.Density([])(0.3) == 1


def test_adaptive_search_beats_random_search():
    adaptive, drawn = [], []
    for seed in range(20):
        adaptive.append(min(t.loss for t in T.search(SPACE, lambda p, fold: surface(p), 1, trials=30, seed=seed)))
        rng = random.Random(seed)
        drawn.append(min(surface(T.draw_params(rng, SPACE)) for _ in range(30)))
    assert median(adaptive) < 0.8 * median(drawn)


def test_weak_trials_stop_early_and_good_ones_do_not():
    calls = []

    def score(p, fold):
        calls.append(fold)
        return surface(p) + 0.001 * fold

    found = T.search(SPACE, score, 7, trials=30, seed=3)
    assert len(calls) < 7 * 30 and any(t.stopped for t in found)
    assert not min(found, key=lambda t: t.loss).stopped
    assert all(2 <= len(t.losses) <= 7 for t in found) and [t.number for t in found] == list(range(30))


def test_equal_losses_stop_nothing_and_repeat():
    found = [T.search(SPACE, lambda p, fold: 1.0, 3, trials=14, seed=2) for _ in range(2)]
    assert found[0] == found[1] and not any(t.stopped for t in found[0])


def test_one_value_spaces_and_few_trials():
    found = T.search({"a": ("flat", 2.0, 2.0, None), "b": ("step", 5, 5, 1)}, lambda p, fold: 0.0, 2, trials=13, batch=5)
    assert len(found) == 13 and all(t.params == {"a": 2.0, "b": 5} for t in found)
