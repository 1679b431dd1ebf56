"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import whole
from tripwise.operators.staging import materialize

VOCABULARY = "byte_bpe_50k.json"
SIZE = 2048
END = 1
GROUP = 2_000
REMEMBERED = 500_000
STRETCH = 1 << 20
WIDTH = 4  # bytes of an id
_WORD_END = re.compile("[A-Za-z](?= )")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTES = _byte_letters()


def _members(kind: str) -> str:
    """The characters of a Unicode class in the basic plane, as ranges for a character class of `re`."""
    ranges, of_kind = [], regex.compile(kind)
    for code in filter(lambda c: not 0xD800 <= c <= 0xDFFF and of_kind.match(chr(c)), range(1 << 16)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


@lru_cache(maxsize=1)
def pattern() -> re.Pattern:
    """The published pattern of byte-level BPE, with its classes spelled out for `re`, which is three times as fast."""
    letter, digit, space = _members(r"\p{L}"), _members(r"\p{N}"), _members(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in stretches of about `most` characters, cut between a letter and a blank, where pre-tokens always end."""
    at = 0
    while len(text) - at > most:
        end = _WORD_END.search(text, at + most)
        if end is None:
            break
        yield text[at:end.end()]
        at = end.end()
    yield text[at:] if at else text


class PieceIds:
    """Ids of texts as little-endian bytes; a pre-token is encoded once and remembered.

    The tokenizer never merges across pre-tokens, so a text's ids are those of its pre-tokens in a row. Texts are split
    here and not by the tokenizer, which would encode a frequent word again each time; its model merges each new one. Characters that the tokenizer
    gives another class (beyond the basic plane, or of a younger Unicode) are found by splitting a probe around each new
    character; a text with one of them, or with the string of an added token, is encoded by the tokenizer alone.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = pattern().findall
        self.four = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.alike = {chr(c) for c in range(128)}
        self.unlike: set[str] = set()

    def _splits_alike(self, character: str) -> bool:
        probe = f"a{character}b1{character}2.{character}. {character}  {character}\n"
        theirs = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return theirs == [m.span() for m in pattern().finditer(probe)]

    def _plain(self, text: str) -> bool:
        if not text.isascii():
            characters = set(text)
            for c in characters - self.alike - self.unlike:
                (self.alike if self._splits_alike(c) else self.unlike).add(c)
            if characters & self.unlike:
                return False
        return not any(a in text for a in self.added)

    def _learn(self, pieces: set[str]) -> None:
        tokens, four = self.tokenizer.model.tokenize, self.four
        self.known.update((p, b"".join([four[t.id] for t in tokens(p.encode().decode("latin-1").translate(BYTES))])) for p in pieces)

    def _together(self, parts: list[str]) -> list[bytes]:
        split = [self.split(p) for p in parts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order. Texts are taken together up to STRETCH characters, longer ones in stretches."""
        waiting, size = [], 0
        for text in texts:
            plain = self._plain(text)
            if waiting and (size + len(text) > STRETCH or not plain):
                yield from self._together(waiting)
                waiting, size = [], 0
            if not plain:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif len(text) > STRETCH:
                yield b"".join(self._together([s])[0] for s in stretches(text))
            else:
                waiting.append(text)
                size += len(text)
        if waiting:
            yield from self._together(waiting)


@lru_cache(maxsize=2)
def piece_ids(vocabulary: str | None) -> PieceIds:
    """`vocabulary` is a path on every executor; null stands for the installed public one."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return PieceIds(vocabulary)


class TournamentTree:
    """Free room of bins 0, 1, 2, ...; each inner node holds the most room below it."""

    def __init__(self, bins: int, size: int):
        self.first = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.first)

    def place(self, length: int) -> int:
        """Put `length` into the first bin with room for it and return the bin."""
        room, node = self.room, 1
        if room[1] < length:
            raise ValueError("no bin has room")
        while node < self.first:
            node *= 2
            if room[node] < length:
                node += 1
        placed = node - self.first
        room[node] -= length
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return placed


def first_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length, longest first, ties in the given order.

    First fit leaves at most one bin not more than half full, so bins are bounded by twice the sum over the size, plus one.
    """
    bins = np.zeros(lengths.size, np.int64)
    tree = TournamentTree(int(2 * lengths.sum() // size) + 1, size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i] = tree.place(int(lengths[i]))
    return bins


def _cut(size: int, end: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = piece_ids(vocabulary), np.array([end], "<u4").tobytes()
        partition, row, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            docs, pieces = [], []
            for i, ids in enumerate(ids_of.of(batch.column(1).to_pylist())):
                ids += last
                n, row = len(ids) // WIDTH, row + 1
                # the row's place in its file tells repeated rows apart, so that they spread over all groups
                draw = zlib.crc32(f"{partition}:{row}:{zlib.crc32(ids)}".encode())
                for start in range(0, n, size):
                    piece = ids[start * WIDTH:(start + size) * WIDTH]
                    length = len(piece) // WIDTH
                    sequence = None
                    if length == size:
                        sequence, full = (1 << 62) | (partition << 38) | full, full + 1
                    docs.append(i)
                    pieces.append((start, length, zlib.crc32(piece), n, draw, sequence))
            columns = list(zip(*pieces)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw", "sequence_id"])

    return run


def _packed(size: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("draw", "ascending"), ("doc_tokens", "ascending"), ("ids_crc32", "ascending")])
        lengths = group["length"].to_numpy().astype(np.int64)
        bins = first_fit_decreasing(lengths, size)
        order = np.lexsort((np.arange(bins.size), -lengths, bins))
        before = np.cumsum(lengths[order]) - lengths[order]
        opens = np.concatenate(([True], np.diff(bins[order]) > 0))
        offsets = np.empty_like(lengths)
        offsets[order] = before - before[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        sequence = (int(key[0].as_py()) << 24) | bins
        return group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column(
            "sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return run


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END,
         vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens; one row for each piece of a document.

    `doc_id`, `start` (the document's ids before the piece), `length`, `ids_crc32` (unsigned, over little-endian 32-bit
    ids), `doc_tokens` (with the closing id `end`), `sequence_id`, `offset` (place in the sequence, gapless from 0).

    A document's ids are cut from the front into pieces of `size`; those fill a sequence each and go no further. What is
    left, one piece shorter than `size` a document, goes to a random group of about `group` documents, and each
    group is packed on its own: longest first, each into the first sequence with room. Texts are read once and never
    shuffled; a group holds a bounded number of short rows. Groups are drawn from the row's place and its ids, so
    copies and repeated rows spread evenly; reruns over equal files with equal splits agree.

    A null or empty text is the closing id alone. Null ids and repeated rows are documents like any other. Very long texts
    become as many pieces as they need. An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col).cast("string")).alias("text"))
    pieces = materialize(texts.mapInArrow(
        _cut(size, end, vocabulary),
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, draw bigint, sequence_id bigint"), "pieces")
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    full = pieces.filter("sequence_id is not null").select(*named, F.lit(0).cast("bigint").alias("offset"))
    short = pieces.filter("sequence_id is null").drop("sequence_id")
    groups = max(1, -(-short.count() // group))
    number = F.pmod(F.xxhash64("draw", "ids_crc32", "doc_tokens"), F.lit(groups))
    packed = short.withColumn("group", number).groupBy("group").applyInArrow(
        _packed(size), f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return full.unionByName(packed)


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: `sequences`, `tokens`, `padding`. A sequence is padded to `size` unless its length is a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.bit_count("tokens") == 1
    return filled.agg(
        F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(power, 0).otherwise(size - F.col("tokens"))), F.lit(0)).alias("padding"))
