"""Token counts that follow edits: sum trees over the pre-tokens of each document."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.common import packed, whole

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of byte-level BPE. A match depends on no text before it and on two characters behind it at most.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
REMEMBERED = 500_000


class PieceCounts(dict):
    """Tokens of a pre-token, encoded once each; starts afresh when full."""

    def __init__(self, vocabulary: str):
        import tiktoken

        super().__init__()
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = count = len(self.encoding.encode_ordinary(piece))
        return count


@lru_cache(maxsize=2)
def piece_counts(vocabulary: str) -> PieceCounts:
    return PieceCounts(vocabulary)


_PIECE = regex.compile(PATTERN)


@dataclass
class TokenTree:
    """Two binary sum trees over runs of about LEAF pre-tokens: characters and tokens.

    Node 1 is the root, the children of node i are 2i and 2i + 1, the leaves are the last half. `pieces` counts the
    pre-tokens of each leaf.
    """

    chars: np.ndarray
    tokens: np.ndarray
    pieces: np.ndarray

    @classmethod
    def build(cls, text: str, counts: PieceCounts) -> TokenTree:
        pieces = _PIECE.findall(text)
        leaves = max(1, -(-len(pieces) // LEAF))
        size = 1 << (leaves - 1).bit_length()
        tree = cls(np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64), np.zeros(size, np.int64))
        if pieces:
            at = np.arange(0, len(pieces), LEAF)
            tree.chars[size:size + leaves] = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at)
            tree.tokens[size:size + leaves] = np.add.reduceat(np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)), at)
            tree.pieces[:leaves] = np.diff(np.append(at, len(pieces)))
        for sums in (tree.chars, tree.tokens):
            level = size
            while level > 1:
                sums[level // 2:level] = sums[level:2 * level:2] + sums[level + 1:2 * level:2]
                level //= 2
        return tree

    @property
    def size(self) -> int:
        return len(self.pieces)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character and the position at which the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int, pieces: int) -> None:
        self.pieces[leaf] = pieces
        node = leaf + self.size
        more_chars, more_tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


def edit(text: str, tree: TokenTree, start: int, length: int, replacement: str, counts: PieceCounts) -> tuple[str, TokenTree, int]:
    """Replace `length` code points from `start`; returns the new text, its tree and how many pre-tokens were encoded again.

    Scanning starts at the leaf of the second character before the edit: a match looks at two characters behind it at most
    ('re, 've and 'll), so whatever ends there or earlier has not looked at the edited text. It stops at the first boundary behind the edit that was the end of a leaf before, as the scan of the
    rest is the same as it was. Only the leaves between are summed again, along their paths to the root.
    """
    start = max(0, min(start, len(text)))
    stop = max(start, min(start + length, len(text)))
    changed = text[:start] + replacement + text[stop:]
    shift = len(changed) - len(text)
    leaf, begin = tree.find(min(max(start - 2, 0), max(len(text) - 1, 0)))
    last, end = leaf, begin + int(tree.chars[tree.size + leaf])  # old end of the leaves scanned so far
    at, chars, tokens, pieces, encoded = begin, 0, 0, 0, 0
    while True:
        while last + 1 < tree.size and (end < stop or end + shift < at):
            last += 1
            end += int(tree.chars[tree.size + last])
        if at == end + shift and end >= stop or at >= len(changed):
            break
        found = _PIECE.match(changed, at)
        at = found.end()
        chars, tokens, pieces, encoded = chars + at - found.start(), tokens + counts[found.group()], pieces + 1, encoded + 1
    if at >= len(changed):
        last = tree.size - 1
    if pieces > 4 * LEAF:  # a long insertion: deal the pre-tokens out again
        return changed, TokenTree.build(changed, counts), encoded
    tree.put(leaf, chars, tokens, pieces)
    for other in range(leaf + 1, last + 1):
        if tree.chars[tree.size + other]:
            tree.put(other, 0, 0, 0)
    return changed, tree, encoded


EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"
TREE = "chars array<bigint>, tokens array<bigint>, pieces array<bigint>"


def _building(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for batch in batches:
            trees = [TokenTree.build(t.as_py(), counts) for t in batch.column(1)]
            arrays = [pa.array([getattr(t, name) for t in trees], pa.list_(pa.int64())) for name in ("chars", "tokens", "pieces")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "chars", "tokens", "pieces"])
    return run


def token_trees(documents: DataFrame, edits=None, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edits and the sum trees (`chars`, `tokens`, `pieces`) of every document; `tokens[1]` is its count.

    Null and empty texts have a tree of one empty leaf. `edits` is a column of the documents or an expression (default:
    none); see `recount`.
    """
    edits = F.array().cast(EDITS) if edits is None else edits
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(F.col(text_col)).alias("text"),
                            F.coalesce(edits.cast(EDITS), F.array().cast(EDITS)).alias("edits"))
    return rows.mapInArrow(_building(vocabulary), f"doc_id bigint, text string, edits {EDITS}, {TREE}")


def _recounting(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for batch in batches:
            out = []
            names = ("doc_id", "text", "edits", "chars", "tokens", "pieces")
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for row in range(batch.num_rows):
                doc_id, text, edits = (c[row].as_py() for c in columns[:3])
                tree = TokenTree(*[np.array(c[row].values, np.int64) for c in columns[3:]])
                before, all_pieces, encoded = int(tree.tokens[1]), int(tree.pieces.sum()), 0
                new = text
                for e in edits:
                    new, tree, again = edit(new, tree, int(e["start"] or 0), int(e["length"] or 0), e["replacement"] or "", counts)
                    encoded += again
                out.append((doc_id, len(text), before, all_pieces, len(new), int(tree.tokens[1]), encoded))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RECOUNTED)
    return run


RECOUNTED = ["doc_id", "n_chars", "n_tokens", "pieces", "edited_chars", "edited_tokens", "encoded_again"]


def recount(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after the edits of each row: doc_id, n_chars, n_tokens, pieces (pre-tokens), edited_chars,
    edited_tokens, encoded_again (pre-tokens that the edits made necessary to encode).

    Edits are applied in order, each to the text the one before left; a start or length beyond the text is cut to it, and
    nulls in an edit are zero or empty. Repeated rows are counted each; an empty table gives no rows.
    """
    return trees.mapInArrow(_recounting(vocabulary), ", ".join(f"{c} bigint" for c in RECOUNTED))


def with_edits(documents: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Attach a table of edits (doc_id, nth, start, length, replacement) as the column `edits`, ordered by `nth`."""
    lists = edits.groupBy(F.col("doc_id").alias("_of")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("nth", "start", "length", "replacement"))),
        lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement"))).alias("_edits"))
    rows = documents.select(packed(documents), F.col(id_col).alias("_id"))
    return rows.join(lists, F.col("_id") == F.col("_of"), "left").select("_row.*", F.col("_edits").alias("edits"))
