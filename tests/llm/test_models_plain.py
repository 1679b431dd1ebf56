"""The fitted corpus models against plain versions: Kneser-Ney from its definition, gradients by differences."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripwise.llm import pu_quality, toxicity as T


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 5, 8])))
    return [word() for _ in range(300)], {k: [word() for _ in range(60)] + ["bad"] * (9 * k) for k in (0, 1)}


def continuation_counts(words):
    """Distinct characters before each gram of fewer than ORDER characters, over distinct words with their marks."""
    before = defaultdict(set)
    for w in set(words):
        marked = T.START + w + T.END
        for stop in range(1, len(marked) + 1):
            for size in range(1, T.ORDER):
                start = stop - size
                if start >= 0 and marked[start:stop] != T.START:
                    before[marked[start:stop]].add(marked[start - 1] if start else T.NOTHING)
    return {g: len(s) for g, s in before.items()}


class Plain:
    """Interpolated Kneser-Ney with one discount; class counts on top, shared continuation counts below."""

    def __init__(self, words, of_class):
        self.low = continuation_counts(words)
        self.top = {k: Counter(w[max(0, j - T.ORDER + 1):j + 1] for w in (T.START + x + T.END for x in ws) for j in range(1, len(w)))
                    for k, ws in of_class.items()}

    def shared(self, gram):
        if not gram:
            return 1 / T.ALPHABET
        follow = {g: n for g, n in self.low.items() if g[:-1] == gram[:-1]}
        below = self.shared(gram[1:])
        if not follow:
            return below
        return (max(self.low.get(gram, 0) - T.DISCOUNT, 0) + T.DISCOUNT * len(follow) * below) / sum(follow.values())

    def probability(self, k, gram):
        follow = {g: n for g, n in self.top[k].items() if g[:-1] == gram[:-1]}
        below = self.shared(gram[1:])
        if not follow:
            return below
        return (max(self.top[k].get(gram, 0) - T.DISCOUNT, 0) + T.DISCOUNT * len(follow) * below) / sum(follow.values())

    def ratio(self, word):
        marked = T.START + word + T.END
        grams = [marked[max(0, j - T.ORDER + 1):j + 1] for j in range(1, len(marked))]
        return sum(math.log(self.probability(1, g) / self.probability(0, g)) for g in grams)


@pytest.mark.parametrize("seed", [1, 2])
def test_scorer_equals_the_definition(seed):
    words, of_class = corpus(seed)
    everything = words + of_class[0] + of_class[1]
    plain = Plain(everything, of_class)
    contexts = defaultdict(lambda: (0, 0))
    for gram, n in plain.low.items():
        total, kinds = contexts[gram[:-1]]
        contexts[gram[:-1]] = total + n, kinds + 1
    scorer = T.Scorer(*T.log_ratios({k: dict(c) for k, c in plain.top.items()}, plain.low, dict(contexts)))
    asked = ["bad", "a", "zebra", "bde", "ééé", "abcdabcd"] + words[:40]
    assert scorer.words(asked) == pytest.approx([plain.ratio(w) for w in asked], abs=1e-9)


def test_probabilities_add_up_to_one():
    words, of_class = corpus(3)
    plain = Plain(words + of_class[0] + of_class[1], of_class)
    letters = sorted({g[-1] for g in plain.low})
    for context in ("", "a", T.START, T.START + "ba", "abc", "zz"):
        for k in (0, 1):
            known = sum(plain.probability(k, context + c) for c in letters)
            assert known + (T.ALPHABET - len(letters)) * plain.probability(k, context + "\U0001f600") == pytest.approx(1, abs=1e-9)


def test_shared_counts_equal_the_definition(spark):
    words, _ = corpus(4)
    rows = [(" ".join(words[i::7]),) for i in range(7)] + [("",), (None,), (" ".join(words[:50]),)]
    grams, contexts = T.shared_counts(spark.createDataFrame(rows, "text string").repartition(3))
    want = continuation_counts([w for t, in rows for w in T.words_of(t)])
    assert {r["gram"]: r["n"] for r in grams.collect()} == want
    found = {r["context"]: (r["total"], r["kinds"]) for r in contexts.collect()}
    assert found == {c: (sum(n for g, n in want.items() if g[:-1] == c), sum(g[:-1] == c for g in want)) for c in {g[:-1] for g in want}}


def test_slopes_equal_differences():
    rng = np.random.default_rng(5)
    x, by = rng.normal(size=(40, 6)), rng.normal(size=40)
    weights = [rng.normal(size=(6, pu_quality.HIDDEN)), rng.normal(size=pu_quality.HIDDEN), rng.normal(size=pu_quality.HIDDEN), 0.3]
    value = lambda ws: float(by @ pu_quality._net(x, ws)[1])
    slopes = pu_quality._slope(x, pu_quality._net(x, weights)[0], weights, by)
    for i, slope in enumerate(slopes):
        for at in ([()] if np.ndim(slope) == 0 else [tuple(rng.integers(0, n) for n in slope.shape) for _ in range(5)]):
            moved = []
            for h in (1e-5, -1e-5):
                ws = [np.array(w, float) for w in weights]
                ws[i][at] += h
                moved.append(value(ws))
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(float(np.asarray(slope)[at]), abs=1e-5)


def test_the_fit_separates_positives_hidden_among_the_unlabelled():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(1.5, 1, (400, 4)), rng.normal(-1.5, 1, (600, 4))
    weights = pu_quality.fit_non_negative(good[:200], np.concatenate((good[200:], bad)), 0.25)
    score = lambda rows: pu_quality._net(rows, weights)[1]
    assert (score(rng.normal(1.5, 1, (500, 4))) > 0).mean() > 0.9 and (score(rng.normal(-1.5, 1, (500, 4))) < 0).mean() > 0.9
