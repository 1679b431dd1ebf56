"""Benchmark decontamination by latent semantic retrieval: randomised SVD, cosine candidates, subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import packed, tidy, whole
from tripwise.operators.staging import materialize

BLOCK = 16
PASSAGE = 2 * BLOCK
DIMENSIONS = 256
EXTRA = 32
POWER_STEPS = 1
COSINE = 0.5
MATCH = 0.6
ANSWER = 0.5
SURE = 0.7
PASSAGES_AT_ONCE = 384
ITEMS_AT_ONCE = 1000
TEXTS_AT_ONCE = 200
PASSAGES_MEASURED = 1 << 15
SEED = 11
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks separate words as white space does."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


class Vocabulary:
    """Numbers the words of texts; words unknown to the benchmark get `other`."""

    def __init__(self, numbers: dict[bytes, int]):
        self.number, self.other = numbers.get, len(numbers)

    def encode(self, text: str) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.number, words, repeat(self.other)), np.int32, len(words))


@dataclass(frozen=True)
class Benchmark:
    """A block of items: words and answers as word numbers, and the passages they are cut into."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    given: list[bool]
    numbers: dict[bytes, int]
    passages: list[list[int]]
    item_of: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str, str | None]]) -> Benchmark:
        numbers: dict[bytes, int] = {}
        words = [[numbers.setdefault(w, len(numbers)) for w in plain_words(text)] for _, text, _ in items]
        answers = []
        for (_, text, answer), own in zip(items, words):
            sentences = [s for s in map(plain_words, _SENTENCE.split(text or "")) if s]
            asked = plain_words(answer) if answer else (sentences[-1] if sentences else [])
            answers.append([numbers.setdefault(w, len(numbers)) for w in asked])
        passages, item_of = [], []
        for i, own in enumerate(words):
            last = max(0, len(own) - PASSAGE)
            for at in sorted({*range(0, last, BLOCK), last}):
                if own:
                    passages.append(own[at:at + PASSAGE])
                    item_of.append(i)
        return cls([i for i, _, _ in items], words, answers, [bool(a) for _, _, a in items], numbers, passages, np.array(item_of, np.int64))


def common_length(a: list[int], b: list[int]) -> int:
    """Length of a longest common subsequence, a machine word of `a` at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for x in b:
        hit = rows & where.get(x, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        vocabulary, found, docs = Vocabulary(numbers), np.zeros(len(numbers) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                ids = vocabulary.encode(text.as_py())
                found[np.unique(ids)] += 1
                docs += 1
        at = np.flatnonzero(found[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], docs))], names=["term", "n"])
    return run


def inverse_frequencies(documents: DataFrame, text_col: str, numbers: dict[bytes, int]) -> np.ndarray:
    """ln(N / documents with the term) over all documents; last, for words outside the benchmark, the mean of these."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)
    counts = documents.select(whole(F.col(text_col)).alias("text")).mapInArrow(_frequencies(shared), "term bigint, n bigint")
    found = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row for each term
    shared.destroy()
    weights = np.log((found.pop(-1, 0) + 2.0) / (np.array([found.get(i, 0) for i in range(len(numbers))]) + 1.0))
    return np.append(weights, weights.mean() if len(weights) else 1.0)


def _rows_of(lists, weights: np.ndarray) -> np.ndarray:
    """Dense unit TF-IDF rows."""
    rows = np.zeros((len(lists), len(weights) - 1), np.float32)
    for i, ids in enumerate(lists):
        np.add.at(rows[i], np.asarray(ids, np.int64), weights[np.asarray(ids, np.int64)])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _sketching(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, probe = shared.value
        gram, cross = np.zeros((probe.shape[1],) * 2), np.zeros((probe.shape[1], probe.shape[0]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = _rows_of(batch.column(0).slice(at, 256).to_pylist(), weights)
                seen = rows @ probe
                gram += seen.T @ seen
                cross += seen.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([cross.tobytes()])], names=["gram", "cross"])
    return run


def latent_basis(passages: DataFrame, weights: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Right singular vectors (terms x dimensions) of the TF-IDF rows of a table of `ids`, by a randomised SVD.

    A random probe P is multiplied with all rows where they lie; each pass returns Y'Y and Y'A for Y = A P, summed over
    the tasks. Y = Q R by the Cholesky factor of Y'Y, and the SVD of B = Q'A, which is small, gives the vectors. A pass
    before that replaces the random probe by A'A times itself.
    """
    spark, terms = passages.sparkSession, len(weights) - 1
    width = min(dimensions + EXTRA, terms)
    probe = np.random.default_rng(SEED).normal(size=(terms, width)).astype(np.float32)
    for step in range(POWER_STEPS + 1):
        shared = spark.sparkContext.broadcast((weights.astype(np.float32), probe))
        parts = passages.mapInArrow(_sketching(shared), "gram binary, cross binary").toLocalIterator()
        gram, cross = np.zeros((width, width)), np.zeros((width, terms))
        for part in parts:
            gram += np.frombuffer(part["gram"]).reshape(gram.shape)
            cross += np.frombuffer(part["cross"]).reshape(cross.shape)
        shared.destroy()
        if step < POWER_STEPS:
            probe = np.linalg.qr(cross.T)[0].astype(np.float32)
    values, vectors = np.linalg.eigh(gram)
    kept = values > values.max(initial=0) * 1e-6
    small = (vectors[:, kept] / np.sqrt(values[kept])).T @ cross  # Q'A, with the symmetric root in place of Cholesky's
    return np.linalg.svd(small, full_matrices=False)[2][:dimensions].T


class Retriever:
    """Finds the items of a benchmark in texts."""

    def __init__(self, bench: Benchmark, weights: np.ndarray, basis: np.ndarray, cosine: float, match: float, answer: float):
        self.bench, self.cosine, self.match, self.answer = bench, cosine, match, answer
        self.vocabulary = Vocabulary(bench.numbers)
        terms = len(weights) - 1
        self.squares = np.append(weights ** 2, 0.0).astype(np.float32)  # other words, then padding
        self.known = self.squares.copy()
        self.known[terms:] = 0
        self.vectors = np.zeros((terms + 2, basis.shape[1]), np.float32)
        self.vectors[:terms] = basis * weights[:-1, None]
        latent = _rows_of(bench.passages, weights) @ basis.astype(np.float32)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).T

    def masses(self, rows: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared TF-IDF length of each passage, whole and of the benchmark's words alone. A word that occurs c times counts
        c * c times its squared weight: its r-th occurrence adds 2r - 1 of them."""
        pad = len(self.squares) - 1
        whole_mass, known_mass = np.empty(len(inside)), np.empty(len(inside))
        for at in range(0, len(inside), PASSAGES_MEASURED):
            to = min(at + PASSAGES_MEASURED, len(inside))
            second = np.where(inside[at:to, None], rows[at + 1:to + 1], pad)
            words = np.sort(np.concatenate((rows[at:to], second), 1), 1)
            nth = np.ones(words.shape, np.int16)
            for j in range(1, words.shape[1]):
                nth[:, j] = np.where(words[:, j] == words[:, j - 1], nth[:, j - 1] + 1, 1)
            known_mass[at:to] = (self.known[words] * (2 * nth - 1)).sum(1)
            whole_mass[at:to] = known_mass[at:to] + (self.squares[words] - self.known[words]).sum(1)
        return whole_mass, known_mass

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(text, word, item, cosine) of passages near an item in the latent space.

        A passage of 32 words starts at every 16th word. Its length is that of its TF-IDF row, where words unknown to the
        benchmark count as different ones. The part of it that the benchmark's words make up bounds the cosine, as the
        latent space only shortens vectors, so passages with too small a part are passed over and none is lost.
        """
        pad = len(self.squares) - 1
        blocks = [max(1, -(-len(t) // BLOCK)) for t in texts]
        first = np.concatenate(([0], np.cumsum(blocks)))
        words = np.full(int(first[-1] + 1) * BLOCK, pad, np.int32)
        for at, text in zip(first, texts):
            words[at * BLOCK:at * BLOCK + len(text)] = text
        rows = words.reshape(-1, BLOCK)
        begins = np.arange(int(first[-1]))
        text_of = np.repeat(np.arange(len(texts)), blocks)
        alone = (np.array(blocks) == 1)[text_of]
        # the last block of a text is part of the passage before it; a text of one block is its own passage
        inside = np.append(text_of[1:] == text_of[:-1], False)
        whole_mass, known_mass = self.masses(rows, inside)
        able = (inside | alone) & (known_mass >= self.cosine ** 2 * whole_mass) & (known_mass > 0)
        needed = able.copy()
        needed[1:] |= able[:-1] & inside[:-1]
        rank = np.cumsum(needed) - 1
        needed, able = np.flatnonzero(needed), begins[able]
        for at in range(0, len(able), 2048):
            part = able[at:at + 2048]
            low, high = rank[part[0]], rank[part[-1] + inside[part[-1]]] + 1
            sums = np.empty((high - low, self.vectors.shape[1]), np.float32)
            for i, block in enumerate(rows[needed[low:high]]):
                sums[i] = self.vectors[block[block < pad - 1]].sum(0)
            own = sums[rank[part] - low]
            joined = inside[part]
            own[joined] += sums[rank[part[joined] + 1] - low]
            near = (own @ self.latent) / np.sqrt(whole_mass[part])[:, None]
            for i, j in zip(*np.nonzero(near >= self.cosine)):
                text = int(text_of[part[i]])
                yield text, int(part[i] - first[text]) * BLOCK, int(self.bench.item_of[j]), min(1.0, float(near[i, j]))

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, cosine, match, answer match, word) of verified candidates, the best one for each text and item."""
        places: dict[tuple[int, int], dict[int, float]] = {}
        for text, word, item, cosine in self.candidates(texts):
            found = places.setdefault((text, item), {})
            found[word] = max(cosine, found.get(word, 0.0))
        out = []
        for (text, item), found in places.items():
            words, answer = self.bench.words[item], self.bench.answers[item]
            best, done = None, set()
            for word, cosine in found.items():
                low = max(0, word - len(words)) // BLOCK * BLOCK
                if (low, len(words)) in done:
                    continue
                done.add((low, len(words)))
                region = texts[text][low:word + PASSAGE + len(words)].tolist()
                share = common_length(words, region) / len(words)
                if share >= self.match and (best is None or share > best[1]):
                    said = common_length(answer, region) / len(answer) if answer else 1.0
                    # a last sentence only stands in for an answer: without it a high match is enough
                    if said >= self.answer or share > SURE and not self.bench.given[item]:
                        best = (cosine, share, said, word)
            if best:
                out.append((text, item, *best))
        return out


FOUND = "doc_id bigint, item_id bigint, cosine double, matched double, answered double, word bigint"


def _searching(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Retriever(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                ids = batch.column(0).slice(at, TEXTS_AT_ONCE)
                texts = [finder.vocabulary.encode(t.as_py()) for t in batch.column(1).slice(at, TEXTS_AT_ONCE)]
                found = finder.matches(texts)
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(columns[0])), pa.array([finder.bench.ids[i] for i in columns[1]], pa.int64()),
                         *[pa.array(c, pa.float64()) for c in columns[2:5]], pa.array(columns[5], pa.int64())],
                        names=["doc_id", "item_id", "cosine", "matched", "answered", "word"])
    return run


def _in_order(items: DataFrame) -> Iterator[tuple]:
    """The rows (item_id, text, answer) in order, repeated ones as often as they are there. ITEMS_AT_ONCE different ones come
    to the driver at a time, in one job however many partitions there are."""
    keys = ["item_id", "text", "answer"]
    table = materialize(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), "benchmark-items")
    rest = table
    while lot := rest.orderBy(*keys).limit(ITEMS_AT_ONCE).collect():
        for row in lot:
            for _ in range(row["times"]):
                yield tuple(row)[:3]
        if len(lot) < ITEMS_AT_ONCE:
            return
        last = F.struct(*[F.lit(lot[-1][c]).cast(table.schema[c].dataType).alias(c) for c in keys])
        rest = table.filter(F.struct(*keys) > last)


def _retrievers(documents: DataFrame, benchmark: DataFrame, text_col: str, answer_col: str | None, dimensions: int,
                cosine: float, match: float, answer: float):
    """The broadcast search state for each block of items: the stated query set, in blocks of so many passages that the
    latent space can tell them all apart."""
    spark = documents.sparkSession
    asked = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text", asked.alias("answer"))

    def prepare(block: list[tuple]):
        bench = Benchmark.of(block)
        weights = inverse_frequencies(documents, text_col, bench.numbers)
        table = spark.createDataFrame([(p,) for p in bench.passages], "ids array<int>")
        basis = latent_basis(table, weights, dimensions)
        tidy(spark)
        return spark.sparkContext.broadcast((bench, weights, basis, cosine, match, answer))

    block, passages = [], 0
    for row in _in_order(items):
        more = -(-len(plain_words(row[1])) // BLOCK)
        if not more:
            continue
        if block and passages + more > PASSAGES_AT_ONCE:
            yield prepare(block)
            block, passages = [], 0
        block.append(row)
        passages += more
    if block:
        yield prepare(block)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None,
                 dimensions: int = DIMENSIONS, cosine: float = COSINE, match: float = MATCH, answer: float = ANSWER) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, cosine (of the latent vectors), matched
    (share of the item's words that occur in this order near the passage), answered (the same for the answer alone), word
    (start of the passage, in words).

    An item is found where a passage is near it in the latent space, `matched` is at least `match` and `answered` at least
    `answer`. Where the benchmark gives no answer, the item's last sentence stands in for it, and an item that matches by
    more than SURE is found without. Weights are counted over all
    documents. The latent space is that of the benchmark's passages, into which documents are folded: only there
    items have to be told apart. Null and empty texts contain nothing; null items or ids of items are skipped; items
    without words are never found; repeated rows are reported each; an empty table on either side gives no rows. Texts are
    never shuffled.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    found = [rows.mapInArrow(_searching(r), FOUND)
             for r in _retrievers(documents, benchmark, text_col, answer_col, dimensions, cosine, match, answer)]
    out = documents.sparkSession.createDataFrame([], FOUND) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    import pandas as pd
    from pyspark.sql import types as T

    settings = {"answer_col": None, "dimensions": DIMENSIONS, "cosine": COSINE, "match": MATCH, "answer": ANSWER} | settings
    state = packed(documents)
    rows = documents.select(state)
    for shared in _retrievers(documents, benchmark, text_col, **settings):
        def search(texts, shared=shared):
            finder, out = Retriever(*shared.value), []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                part = [finder.vocabulary.encode(t or "") for t in texts.iloc[at:at + TEXTS_AT_ONCE]]
                hit = {m[0] for m in finder.matches(part)}
                out += [i in hit for i in range(len(part))]
            return pd.Series(out, dtype=bool)

        rows = rows.filter(~F.pandas_udf(search, T.BooleanType())(F.col(f"_row.`{text_col}`")))
    return rows.select("_row.*")
