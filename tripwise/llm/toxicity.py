"""Toxicity by class-conditional Kneser-Ney models of the characters of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import drawn, held_out, seeded_key, whole

SEED = "toxic-1"
ORDER = 5
DISCOUNT = 0.75
MARGIN = 1.0
FIT_ROWS = 10_000
CALIBRATION_PARTS = 5
WORDS_AT_ONCE = 500_000
LETTERS_AT_ONCE = 1_000_000
SHIFT = np.uint64(21)  # a code point and one fit in 21 bits
ALPHABET = 1000
NOTHING, START, END = "\x01", "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def top_grams(word: str) -> Iterator[str]:
    """Each character of a word (and its end) after up to ORDER - 1 characters before it."""
    padded = START + word + END
    return (padded[max(0, j - ORDER + 1):j + 1] for j in range(1, len(padded)))


def _letters(words: list[str], lead: str) -> tuple[str, np.ndarray, np.ndarray]:
    """All words between `lead` and END in one string, its code points (one more, so that 0 is free), and the place of each
    character in its word."""
    joined = "".join([lead + word + END for word in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(lead) + 1
    return joined, points, np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _continuations(words: list[str]) -> set[str]:
    """Grams of fewer than ORDER characters, each behind the character that stands before it (NOTHING at a word's start)."""
    joined, points, place = _letters(words, NOTHING + START)
    found: set[str] = set()
    numbers = points  # one for each string that ends here: equal for equal strings
    for n in range(2, ORDER + 1):
        ends = np.flatnonzero(place >= n - 1)
        codes, kinds = pd.factorize(numbers[ends - 1] << SHIFT | points[ends])
        an_end = np.empty(len(kinds), np.int64)
        an_end[codes] = ends
        found.update([joined[i - n + 1:i + 1] for i in an_end.tolist()])
        numbers = np.zeros(len(points), np.uint64)
        numbers[ends] = codes
    found.discard(NOTHING + START)  # the marks alone
    return found


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _corpus_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts, each once for every WORDS_AT_ONCE different ones."""
    words: set[str] = set()
    for batch in batches:
        for text in batch.column(0):
            words.update(words_of(text.as_py()))
            if len(words) >= WORDS_AT_ONCE:
                yield _batch([list(words)], ["word"])
                words.clear()
    if words:
        yield _batch([list(words)], ["word"])


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[str] = set()

    def pairs() -> pa.RecordBatch:
        return _batch([pa.array([p[1:] for p in found], pa.string()), pa.array([p[0] for p in found], pa.string())], ["gram", "before"])

    for batch in batches:
        found |= _continuations(batch.column(0).to_pylist())
        if len(found) >= WORDS_AT_ONCE:
            yield pairs()
            found.clear()
    if found:
        yield pairs()


def shared_counts(documents: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Backoff counts over all documents, which both classes share: `gram`, `n` (distinct characters before it), and for
    each context `gram`, `total`, `kinds` over the characters that follow it."""
    words = documents.select(whole(F.col(text_col)).alias("text")).mapInArrow(_corpus_words, "word string").distinct()
    pairs = words.mapInArrow(_word_pairs, "gram string, before string").distinct()
    grams = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    context = F.expr("substring(gram, 1, char_length(gram) - 1)")
    contexts = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return grams, contexts


def _class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, times in Counter(words_of(text)).items():
                for gram in top_grams(word):
                    found[toxic, gram] += times
        if found:
            yield _batch([[k[0] for k in found], [k[1] for k in found], list(found.values())], ["toxic", "gram", "n"])


def _suffixes(gram: str) -> Iterator[str]:
    return (gram[i:] for i in range(1, len(gram)))


def log_ratios(of_class: dict[int, dict[str, int]], grams: dict[str, int], contexts: dict[str, tuple[int, int]]) -> tuple[dict, dict]:
    """ln P(toxic) - ln P(ordinary) for each gram that a class has, and for each context with any other character.

    Each class discounts its own counts of a gram; what the discounts leave over is dealt out by the shared
    distribution of the shorter gram, which is interpolated in the same way down to single characters. A character that
    neither class has seen in a context costs both the same shared probability, which therefore cancels out.
    """
    known: dict[str, float] = {}

    def shared(gram: str) -> float:
        if not gram:
            return 1 / ALPHABET
        if gram not in known:
            total, kinds = contexts.get(gram[:-1], (0, 0))
            lower = shared(gram[1:])
            known[gram] = lower if not total else (max(grams.get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * kinds * lower) / total
        return known[gram]

    total: dict[int, Counter] = {k: Counter() for k in (0, 1)}
    kinds: dict[int, Counter] = {k: Counter() for k in (0, 1)}
    for k, counts in of_class.items():
        for gram, n in counts.items():
            total[k][gram[:-1]] += n
            kinds[k][gram[:-1]] += 1

    def left_over(k: int, context: str) -> float:
        return DISCOUNT * kinds[k][context] / total[k][context] if total[k][context] else 1.0

    def probability(k: int, gram: str) -> float:
        context = gram[:-1]
        own = max(of_class[k].get(gram, 0) - DISCOUNT, 0.0) / total[k][context] if total[k][context] else 0.0
        return own + left_over(k, context) * shared(gram[1:])

    seen = {g: math.log(probability(1, g) / probability(0, g)) for g in of_class[0].keys() | of_class[1].keys()}
    other = {c: math.log(left_over(1, c) / left_over(0, c)) for c in total[0].keys() | total[1].keys()}
    return seen, other


def _columns(grams: list[str], size: int) -> list[np.ndarray]:
    """The characters of grams as numbers, oldest first, zeros before short ones."""
    joined = "".join([g.rjust(size, "\0") for g in grams])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, size) + np.uint64(1)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    points[np.arange(size) < (size - sizes)[:, None]] = 0
    return list(points.T)


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted list, or the list's length."""
    at = np.searchsorted(known, keys)
    at[known.take(at, mode="clip") != keys] = len(known)
    return at.astype(np.uint64)


class Scorer:
    """Length-normalised log-likelihood ratios of texts, with the ratios of words remembered.

    A gram is found in three steps, each a search among sorted numbers: its first three characters, these with the
    fourth (its context), these with the last. Grams at a word's start have zeros in front.
    """

    def __init__(self, seen: dict[str, float], other: dict[str, float]):
        self.known: dict[str, float] = {}
        columns = _columns(list(other), ORDER - 1)
        self.heads = np.unique(self._head(columns))
        self.contexts, self.other = self._sorted(self._context_key(columns), other)
        columns = _columns(list(seen), ORDER)
        self.grams, self.seen = self._sorted(self._context(columns) << SHIFT | columns[4], seen)

    @staticmethod
    def _sorted(keys: np.ndarray, values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and their values with a zero for what is not found."""
        order = np.argsort(keys)
        return keys[order], np.append(np.fromiter(values.values(), np.float64, len(values))[order], 0.0)

    @staticmethod
    def _head(columns: list[np.ndarray]) -> np.ndarray:
        return (columns[0] << SHIFT | columns[1]) << SHIFT | columns[2]

    def _context_key(self, columns: list[np.ndarray]) -> np.ndarray:
        return _find(self.heads, self._head(columns)) << SHIFT | columns[3]

    def _context(self, columns: list[np.ndarray]) -> np.ndarray:
        return _find(self.contexts, self._context_key(columns))

    def words(self, words: list[str]) -> list[float]:
        """The ratio of each word: the sum over its characters and its end."""
        _, points, place = _letters(words, START)
        columns = []
        for back in range(ORDER - 1, -1, -1):
            column = np.zeros_like(points)
            column[back:] = points[:max(len(points) - back, 0)]
            columns.append(np.where(place >= back, column, np.uint64(0)))
        context = self._context(columns)
        gram = _find(self.grams, context << SHIFT | columns[4])
        ratio = np.where(gram < len(self.grams), self.seen[gram], self.other[context])
        return np.bincount(np.cumsum(place == 0) - 1, np.where(place > 0, ratio, 0.0)).tolist()

    def texts(self, texts: list[str]) -> list[tuple[float, float]]:
        """Of each text the mean ratio of a word, and the mean of what its ratio has above MARGIN."""
        of_texts = [words_of(t) for t in texts]
        if len(self.known) >= WORDS_AT_ONCE:
            self.known.clear()
        new = list(set().union(*of_texts) - self.known.keys())
        if new:
            self.known.update(zip(new, self.words(new)))
        found = []
        for words in of_texts:
            ratios = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
            found.append((float(ratios.mean()), float(np.maximum(ratios - MARGIN, 0).mean())) if words else (0.0, 0.0))
        return found


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in order, as many at once as have LETTERS_AT_ONCE characters."""
    group, letters = [], 0
    for text in texts:
        group.append(text.as_py())
        letters += len(group[-1])
        if letters >= LETTERS_AT_ONCE:
            yield group
            group, letters = [], 0
    if group:
        yield group


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            pairs = [pair for group in _groups(batch.column(1)) for pair in scorer.texts(group)]
            mean, excess = (pa.array([p[i] for p in pairs], pa.float64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), mean, excess], names=["doc_id", "mean", "excess"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic fit with a slight ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS):
    """The broadcast model and the coefficients of the score, or None without labelled rows of both classes.

    Labels of ids that are not held out are read; of each class a seeded draw of at most `rows` ids. Four fifths of
    them are counted, the last fifth turns ratios into a probability. The backoff counts are those of all documents;
    the counts of the drawn rows' own grams are all that comes to the driver.
    """
    spark = documents.sparkSession
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("key", seeded_key(SEED, F.col("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    taken = [(r["doc_id"], k, r["key"] % CALIBRATION_PARTS == 0) for k in (0, 1)
             for r in drawn(known.filter(F.col("toxic") == k).select("doc_id", "key"), "key", rows)]
    if len(sizes) < 2:
        return None
    chosen = F.broadcast(spark.createDataFrame(taken, "doc_id bigint, toxic bigint, calibrates boolean"))  # 2 * rows ids at most
    texts = documents.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text")).join(chosen, "doc_id")
    counted = texts.filter("not calibrates").select("toxic", "text").mapInArrow(_class_grams, "toxic bigint, gram string, n bigint")
    of_class: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in counted.groupBy("toxic", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        of_class[r["toxic"]][r["gram"]] = r["n"]
    needed = {s for counts in of_class.values() for g in counts for s in _suffixes(g)}
    if not needed:
        return None
    wanted = spark.createDataFrame([(s,) for s in needed | {s[:-1] for s in needed}], "gram string")
    grams, contexts = shared_counts(documents, text_col)
    grams = grams.persist()  # read twice; only distinct grams
    shared = {r["gram"]: r["n"] for r in grams.join(wanted, "gram").toLocalIterator()}
    follow = {r["context"]: (r["total"], r["kinds"])
              for r in contexts.join(wanted.withColumnRenamed("gram", "context"), "context").toLocalIterator()}
    grams.unpersist()
    model = spark.sparkContext.broadcast(log_ratios(of_class, shared, follow))
    held = texts.filter("calibrates").select("doc_id", "text").mapInArrow(_scoring(model), "doc_id bigint, mean double, excess double")
    held = held.join(chosen, "doc_id").select("toxic", "mean", "excess").collect()
    if len({r["toxic"] for r in held}) < 2:
        return None
    share = {k: min(1.0, rows / sizes[k]) for k in (0, 1)}
    data = np.array([(r["mean"], r["excess"], r["toxic"]) for r in held])
    weight = np.where(data[:, 2] == 1, 1 / share[1], 1 / share[0])
    return model, _logistic(data[:, :2], data[:, 2], weight)


def toxicity_table(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) and the two ratios for every document.

    The score depends on the whole text alone. Null and empty texts have ratios of zero; repeated rows get equal scores;
    without labelled rows of both classes every score is 0; an empty table gives no rows. Labels of null ids or with a
    null class are not used.
    """
    fitted = fit(documents, labels, id_col, text_col)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    if fitted is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("mean"), F.lit(0.0).alias("excess"), F.lit(0.0).alias("score"))
    else:
        model, (base, by_mean, by_excess) = fitted
        ratios = rows.mapInArrow(_scoring(model), "doc_id bigint, mean double, excess double")
        logit = F.lit(float(base)) + float(by_mean) * F.col("mean") + float(by_excess) * F.col("excess")
        scored = ratios.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0)))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("mean").alias("mean_ratio"),
                         F.col("excess").alias("mean_excess"))
