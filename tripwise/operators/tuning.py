"""Adaptive search for parameters: proposals by the ratio of densities of good and bad trials."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import median

STARTUP = 10  # trials drawn at random before the first density
GOOD = 0.25  # share of trials that count as good
CANDIDATES = 24


@dataclass(frozen=True)
class Trial:
    """One parameter set with the losses of the folds it was scored on."""

    number: int
    params: dict
    losses: tuple[float, ...]
    folds: int

    @property
    def loss(self) -> float:
        return sum(self.losses) / len(self.losses)

    @property
    def stopped(self) -> bool:
        return len(self.losses) < self.folds


def _place(value: float, kind: str, low: float, high: float) -> float:
    """Where the value lies in its range, from 0 to 1; on a log scale for `log`."""
    if kind == "log":
        value, low, high = math.log(value), math.log(low), math.log(high)
    return (value - low) / (high - low) if high > low else 0.5


def _value(place: float, kind: str, low: float, high: float, step) -> float:
    if kind == "log":
        return math.exp(math.log(low) + place * (math.log(high) - math.log(low)))
    if kind == "step":
        return low + step * min(int((high - low) // step), max(0, round(place * (high - low) / step)))
    return low + place * (high - low)


class Density:
    """A mixture on [0, 1] of an even part and one bell around each point, cut off at the ends.

    A bell is as wide as the larger gap to its neighbours, within limits that narrow as points gather.
    """

    def __init__(self, points: list[float]):
        at = sorted(points)
        ends = [0.0, *at, 1.0]
        least = 1 / min(100, len(at) + 2)
        self.bells = []
        for i, m in enumerate(at, 1):
            s = min(0.5, max(least, m - ends[i - 1], ends[i + 1] - m))
            self.bells.append((m, s, self._below((1 - m) / s) - self._below(-m / s)))

    @staticmethod
    def _below(z: float) -> float:
        return 0.5 * (1 + math.erf(z / math.sqrt(2)))

    def __call__(self, x: float) -> float:
        total = 1.0
        for m, s, inside in self.bells:
            total += math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.bells) + 1)

    def draw(self, rng: random.Random) -> float:
        chosen = rng.randrange(len(self.bells) + 1)
        if chosen == len(self.bells):
            return rng.random()
        m, s, _ = self.bells[chosen]
        while not 0 <= (x := rng.gauss(m, s)) <= 1:
            pass
        return x


def draw_params(rng: random.Random, space: dict) -> dict:
    """An even draw from the space (name to kind, low, high, step)."""
    return {name: _value(rng.random(), *bounds) if bounds[0] != "step"
            else bounds[1] + bounds[3] * rng.randint(0, int((bounds[2] - bounds[1]) // bounds[3])) for name, bounds in space.items()}


def propose(rng: random.Random, space: dict, history: list[Trial], pending: list[dict]) -> dict:
    """The next parameter set.

    Trials are split into the best quarter and the rest; trials that still run count among the rest, so that a batch
    spreads out. For each parameter the candidate, drawn from the good density, with the greatest ratio of the good to
    the bad density is taken. A trial stopped early never counts as good.
    """
    if len(history) < STARTUP:
        return draw_params(rng, space)
    ranked = sorted(history, key=lambda t: (t.stopped, t.loss, t.number))
    cut = max(1, math.ceil(GOOD * len(ranked)))
    good = [t.params for t in ranked[:cut] if not t.stopped] or [ranked[0].params]
    bad = [t.params for t in ranked[cut:]] + pending
    out = {}
    for name, (kind, low, high, step) in space.items():
        better, worse = (Density([_place(p[name], kind, low, high) for p in group]) for group in (good, bad))
        best = max((better.draw(rng) for _ in range(CANDIDATES)), key=lambda x: better(x) / worse(x))
        out[name] = _value(best, kind, low, high, step)
    return out


def is_weak(losses: tuple[float, ...], history: list[Trial], grace: int) -> bool:
    """Whether a trial's mean over its first folds is above the median of earlier trials' means over as many folds."""
    n = len(losses)
    others = [sum(t.losses[:n]) / n for t in history if len(t.losses) >= n]
    return n >= grace and len(others) >= STARTUP // 2 and sum(losses) / n > median(others)


def search(space: dict, score: Callable[[dict, int], float], folds: int, trials: int = 30, batch: int = 4, seed: int = 0,
           grace: int = 2) -> list[Trial]:
    """Run `trials` parameter sets in batches; `score(params, fold)` gives the loss of fold 1, 2, ..., `folds`.

    Trials of a batch run side by side, each fold by fold, and stop when they are weak. Proposals and stops see finished
    batches only, so a search with one seed repeats itself however its jobs are timed.
    """
    rng, history = random.Random(seed), []

    def run(number: int, params: dict) -> Trial:
        losses: tuple[float, ...] = ()
        for fold in range(1, folds + 1):
            losses += (float(score(params, fold)),)
            if fold < folds and is_weak(losses, before, grace):
                break
        return Trial(number, params, losses, folds)

    with ThreadPoolExecutor(max_workers=batch) as pool:
        while len(history) < trials:
            before, proposed = list(history), []
            for _ in range(min(batch, trials - len(history))):
                proposed.append(propose(rng, space, before, proposed))
            history += pool.map(run, range(len(before), len(before) + len(proposed)), proposed)
    return history
