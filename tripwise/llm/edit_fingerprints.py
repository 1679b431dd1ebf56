"""Document fingerprints by a randomised edit embedding: shared random walks, sampled positions, bands, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.llm.common import whole
from tripwise.llm.graph import components
from tripwise.operators.staging import materialize

CLASSES = 16  # two make a byte
PERIOD = 256  # a walk position is a byte
SEED = 20
SAMPLES = 128
BAND = 6
BANDS = SAMPLES // BAND
CHANCE = 1 / 16
NEAR = 0.8
TOGETHER = 2000  # fingerprints of a band that one task compares with as many others at most
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(maxsize=1)
def _moves() -> tuple[np.ndarray, list[bytes]]:
    """For each class of characters and walk position (mod PERIOD), the position after the walk has left that character;
    the same for two characters in a row.

    At every position a shared coin of the class decides whether the walk goes on to the next character, so a character is
    written once or more often, twice on average.
    """
    coins = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
    one = np.empty((CLASSES, PERIOD), np.uint8)
    for c, coin in enumerate(coins):
        heads = np.flatnonzero(coin)
        following = np.append(heads, heads[0] + PERIOD)
        one[c] = (following[np.searchsorted(heads, np.arange(PERIOD))] + 1) % PERIOD
    two = [one[b][one[a]].tobytes() for a in range(CLASSES) for b in range(CLASSES)]
    return one, two


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=64)
def _positions(level: int) -> np.ndarray:
    """Sampled positions of the embedding at a level, ascending: about one in 2^level of twice SAMPLES * 2^level.
    Those of a level are among those of every finer one."""
    all_of = np.arange(SAMPLES << (level + 1), dtype=np.uint64)
    return all_of[_mixed(all_of + np.uint64(1)) & np.uint64((1 << level) - 1) == 0].astype(np.int64)


@lru_cache(maxsize=64)
def _salts(level: int) -> np.ndarray:
    """A number for each sampled position, so that two letters that look alike at one position differ at others."""
    return (_mixed(_positions(level).astype(np.uint64) + np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=256)
def _kept(level: int, coarser: int) -> np.ndarray:
    """Which of the positions of a level are also positions of a coarser one."""
    return np.isin(_positions(level), _positions(coarser), assume_unique=True)


def _level(length: int) -> int:
    return max(0, (length // SAMPLES).bit_length() - 1)


def fingerprint(text: str | None) -> str:
    """`<length of the embedding>:<one hexadecimal digit for each sampled position>`; null and empty texts give `0:`.

    The embedding repeats each character for as long as its walk stays there. Texts at a small edit distance fall into
    step again after an edit, so their embeddings agree at most positions. A text keeps between SAMPLES and twice as
    many positions whatever its length (fewer only if its embedding is shorter), spread over the whole of it.
    """
    if not text:
        return "0:"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = ((points * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint8)
    if classes.size % 2:
        classes = np.append(classes, np.uint8(0))
    one, two = _moves()
    at, after = 0, bytearray()
    put = after.append
    for pair in (classes[::2] * np.uint8(CLASSES) + classes[1::2]).tobytes():
        at = two[pair][at]
        put(at)
    after = np.frombuffer(after, np.uint8)
    ends = np.cumsum(np.diff(after, prepend=np.uint8(0)), dtype=np.int64)  # differences wrap as the walk does
    length = int(ends[-1])
    if points.size % 2:  # the last pair is one character
        begin = int(after[-2]) if after.size > 1 else 0
        length = (int(ends[-2]) if ends.size > 1 else 0) + (int(one[classes[-2], begin]) - begin) % PERIOD
    level = _level(length)
    where = _positions(level)
    where = where[:np.searchsorted(where, length)]
    pair = np.searchsorted(ends, where, side="right")
    begin = np.where(pair > 0, after[pair - 1], np.uint8(0))
    passed = np.where(pair > 0, ends[pair - 1], 0)
    second = where - passed >= (one[classes[2 * pair], begin] - begin)  # wraps as well
    letters = points[np.minimum(2 * pair + second, points.size - 1)]
    mixed = (letters ^ _salts(level)[:where.size]) * np.uint32(0x9E3779B1)
    digits = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(28)
    return f"{length:x}:" + _HEX[digits].tobytes().decode()


def _aligned(a: str, b: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Digits of both at the positions of the coarser level that both have, and how many positions the longer has."""
    sides = []
    for value in (a, b):
        length, _, digits = value.partition(":")
        sides.append((int(length, 16), np.frombuffer(digits.encode(), np.uint8)))
    level = max(_level(sides[0][0]), _level(sides[1][0]))
    kept = [digits[_kept(_level(length), level)[:digits.size]] for length, digits in sides]
    shared = min(kept[0].size, kept[1].size)
    return kept[0][:shared], kept[1][:shared], max(kept[0].size, kept[1].size)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of sampled positions at which two embeddings agree, less what chance alone gives."""
    if a == b:
        return 1.0
    left, right, positions = _aligned(a, b)
    agree = float((left == right).sum()) / max(positions, 1)
    return max(0.0, (agree - CHANCE) / (1 - CHANCE))


def bands(value: str) -> list[str]:
    """Keys by which like fingerprints meet: runs of sampled digits at the own level and, as the other text may be just
    long enough for the next, at that one. Embeddings shorter than a run are one key."""
    length, _, digits = value.partition(":")
    own, keys = _level(int(length, 16)), []
    digits = np.frombuffer(digits.encode(), np.uint8)
    for level in (own, own + 1):
        part = digits if level == own else digits[_kept(own, level)[:digits.size]]
        if part.size < BAND:
            keys.append(f"{level}.s.{part.tobytes().decode()}")
        keys.extend(f"{level}.{i}.{part[i * BAND:(i + 1) * BAND].tobytes().decode()}" for i in range(part.size // BAND))
    return keys


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, edited_candidate boolean, next_candidate boolean")
_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
           "edited_candidate", "next_candidate"]


def _described(doc_id, text: str, own: str, own_bands: set, following: str, next_print: str, next_bands: set) -> tuple:
    changed = edited(text, following)
    changed_print = own if changed == text else fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, changed_print,
            likeness(own, changed_print), likeness(own, next_print),
            not own_bands.isdisjoint(bands(changed_print)), not own_bands.isdisjoint(next_bands))


def _arrow(rows: list[tuple], names: list[str], types: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, columns)], names=names)


_TYPES = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(),
          "edited_candidate": pa.bool_(), "next_candidate": pa.bool_(), "edge": pa.string(), "edge_text": pa.string(),
          "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string()}


def _pairs_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describe each row of a sorted partition with the row after it. Its first and last row are also given as texts: the
    last row of one partition still has to meet the first of the next."""
    names = [*_FIELDS, "edge", "edge_text"]
    before = None
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = []
            ids, texts = (batch.column(i).slice(at, 500).to_pylist() for i in (0, 1))
            for doc_id, text in zip(ids, texts):
                own = fingerprint(text)
                own_bands = set(bands(own))
                if before is None:
                    rows.append((doc_id, *[None] * 8, "first", text))
                else:
                    rows.append((*_described(*before, text, own, own_bands), None, None))
                before = (doc_id, text, own, own_bands)
            yield _arrow(rows, names, _TYPES)
    if before is not None:
        yield _arrow([(before[0], *[None] * 8, "last", before[1])], names, _TYPES)


def _pair_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own, other = fingerprint(text), fingerprint(following)
            rows.append(_described(doc_id, text, own, set(bands(own)), following, other, set(bands(other))))
        yield _arrow(rows, _FIELDS, _TYPES)


def fingerprint_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with the fingerprint of its text and of its edited text (see `edited`; the following
    document is the next by id, after the last the first).

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness to
    the edited text and to the next document), edited_candidate, next_candidate (whether they share a band). Null texts
    are empty; null ids come first; rows of one id are in the order of a hash of their texts; a single document is its
    own next; an empty table gives no rows. Texts are shuffled once, into ranges of ids, and read in order. Only the
    first and last row of each range are written with their texts.
    """
    spark = documents.sparkSession
    text = whole(F.col(text_col))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = ordered.mapInArrow(_pairs_in_order, f"{ROW}, edge string, edge_text string")
    made = materialize(made.withColumn("part", F.spark_partition_id()), "edit-fingerprints")

    edges = made.filter("edge is not null").select("doc_id", "edge", "edge_text", "part")
    filled = edges.filter("edge = 'first'").select("part")  # one number for each range
    following = filled.select("part", F.coalesce(
        F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    last = edges.filter("edge = 'last'").select("doc_id", "edge_text", "part").join(following, "part")
    first = edges.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    joined = last.join(first, "next_part").select("doc_id", "edge_text", "next_text")
    return made.filter("edge is null").select(*_FIELDS).unionByName(joined.mapInArrow(_pair_edges, ROW))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bands_udf(values: pd.Series) -> pd.Series:
    return values.map(bands)


@F.pandas_udf(T.StringType())
def _fingerprint_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint)


def spanning_links(values: list[str], least: float) -> list[tuple[str, str]]:
    """Links that connect exactly what likenesses of at least `least` connect, at most one for each value.

    Values are reached from one another breadth first; each is compared only with those not reached yet.
    """
    parts = [v.partition(":") for v in values]
    level = np.array([_level(int(length, 16)) for length, _, _ in parts])
    digits = [np.frombuffer(d.encode(), np.uint8) for _, _, d in parts]
    tables = {}  # for each level, the digits at its positions of what is as fine, and how many
    for at in set(level.tolist()):
        kept = [d[_kept(own, at)[:d.size]] if own <= at else d[:0] for own, d in zip(level.tolist(), digits)]
        sizes = np.array([k.size for k in kept])
        table = np.zeros((len(values), max(1, int(sizes.max()))), np.uint8)
        for row, k in zip(table, kept):
            row[:k.size] = k
        tables[at] = table, sizes

    def near(one: int, others: np.ndarray) -> np.ndarray:
        out, common = np.zeros(others.size, bool), np.maximum(level[others], level[one])
        for at in set(common.tolist()):
            table, sizes = tables[at]
            here = np.flatnonzero(common == at)
            wanted = table[one].copy()
            wanted[sizes[one]:] = 1  # no digit and not the filling
            agree = (table[others[here]] == wanted).sum(1) / np.maximum(np.maximum(sizes[others[here]], sizes[one]), 1)
            out[here] = np.maximum(0.0, (agree - CHANCE) / (1 - CHANCE)) >= least
        return out

    links, left = [], np.arange(len(values))
    while left.size > 1:
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and left.size:
            hit = near(queue.pop(), left)
            if hit.any():
                reached, left = left[hit].tolist(), left[~hit]
                links.extend((values[first], values[r]) for r in reached)
                queue.extend(reached)
    return links


def _linked(least: float):
    """Rows sorted by band and blocks; one pair of blocks of a band is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            links = spanning_links([r[3] for r in group], least)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*links)], names=["a", "b"])

    return run


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR) -> DataFrame:
    """`doc_id`, `fingerprint`, `group_id`: documents whose fingerprints meet in a band and are verified to be alike.

    Equal fingerprints are one node. Within a band the members are reached breadth first, so all that likenesses connect
    there is one group. A band of more than TOGETHER fingerprints is dealt into blocks by a hash, and each two blocks
    meet in a task of their own. Null and empty texts have one fingerprint and are one group; group_id is the group's
    smallest id.
    """
    text_print = _fingerprint_udf(whole(F.col(text_col)))
    marked = materialize(documents.select(F.col(id_col).alias("doc_id"), text_print.alias("fingerprint")), "fingerprints")
    keyed = marked.select("fingerprint").distinct().select("fingerprint", F.explode(F.array_distinct(_bands_udf("fingerprint"))).alias("band"))
    blocks = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "band", F.ceil(F.col("n") / TOGETHER).cast("bigint").alias("blocks"))
    dealt = keyed.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("fingerprint"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "band", "low", "high").sortWithinPartitions("band", "low", "high", "fingerprint")
    pairs = dealt.mapInArrow(_linked(float(least)), "a string, b string").distinct()
    names = marked.select("fingerprint").distinct().select("fingerprint", F.xxhash64("fingerprint").alias("node"))
    links = pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    roots = components(links, "a", "b")
    placed = names.join(roots, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("root"))
    placed = materialize(marked.join(placed, "fingerprint"), "fingerprint-groups")
    least_id = placed.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return placed.join(least_id, "root").select("doc_id", "fingerprint", "group_id")
