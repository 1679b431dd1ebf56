"""Removal of repeated lines and sentences by global digests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.llm.common import packed, whole
from tripwise.operators.staging import materialize

RUN_WORDS = 1  # every run of repeats goes, whatever its length
FRAGMENT_WORDS = 3  # what a mark inside a line ends counts as a sentence from so many words on, below it as a fragment
LAST = (1 << 63) - 1
# A unit ends at a line break or behind a sentence's last mark.
_UNIT = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)|(?=\n)|\Z)", re.DOTALL)
UNIT_SCHEMA = "doc bigint, mark bigint, nth int, start int, stop int, words int, high bigint, low bigint, again boolean, firm boolean"


def units(text: str | None) -> list[tuple[int, int, int, bytes, bool]]:
    """(start, stop, words, digest, firm) of each line or sentence with at least one word, offsets in code points.

    The digest is that of the lower-cased words joined by single spaces, without marks at the ends. A unit is firm if it is
    a whole line or has FRAGMENT_WORDS words; others are fragments.
    """
    found, lines, line, at, text = [], [], 0, 0, text or ""
    while at < len(text):
        line += text[at] == "\n"
        stop = _UNIT.match(text, at).end()
        words = text[at:stop].lower().split()
        plain = " ".join(words).strip(" .,;:!?\"'()[]*-")
        if plain:
            start = at + len(text[at:stop]) - len(text[at:stop].lstrip())
            found.append((start, stop, len(words), hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
            lines.append(line)
        at = max(stop, at + 1) if stop == at else stop
    alone = Counter(lines)
    return [(*unit, alone[n] == 1 or unit[2] >= FRAGMENT_WORDS) for unit, n in zip(found, lines)]


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            docs, marks, nths, starts, stops, words, digests, again, firm = [], [], [], [], [], [], [], [], []
            for doc, text, mark in zip(batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500),
                                       batch.column(2).slice(at, 500).to_pylist()):
                seen = set()
                for nth, (start, stop, n, digest, whole_unit) in enumerate(units(text.as_py())):
                    docs.append(doc)
                    marks.append(mark)
                    firm.append(whole_unit)
                    nths.append(nth)
                    starts.append(start)
                    stops.append(stop)
                    words.append(n)
                    digests.append(digest)
                    again.append(digest in seen)
                    seen.add(digest)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), *[pa.array(c, pa.int32()) for c in (nths, starts, stops, words)],
                 pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(again, pa.bool_()), pa.array(firm, pa.bool_())],
                names=["doc", "mark", "nth", "start", "stop", "words", "high", "low", "again", "firm"])


def _spans(documents: DataFrame, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """Spans by `doc` (LAST for none) and `mark` (hash of the text): two texts of one id are two documents."""
    text = whole(F.col(text_col))
    rows = documents.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"))
    table = materialize(rows.mapInArrow(_unit_rows, UNIT_SCHEMA), "units")
    first = F.min(F.struct("doc", "mark")).alias("first")
    firsts = table.groupBy("high", "low").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "high", "low", F.col("first.doc").alias("first"), F.col("first.mark").alias("first_mark"))
    firsts = materialize(firsts, "repeated-units")  # in a join with a written table Spark can split the occurrences of one digest
    later = (F.col("doc") > F.col("first")) | (F.col("doc") == F.col("first")) & (F.col("mark") > F.col("first_mark"))
    repeats = table.join(firsts, ["high", "low"]).filter(F.col("again") | later)
    repeats = repeats.select("doc", "mark", "nth", "start", "stop", "words", "first", "firm").distinct()  # rows that are there twice
    in_doc = Window.partitionBy("doc", "mark").orderBy("nth")
    runs = repeats.withColumn("run", F.col("nth") - F.row_number().over(in_doc))
    spans = runs.groupBy("doc", "mark", "run").agg(
        F.min("start").alias("span_start"), F.max("stop").alias("span_end"), F.sum("words").cast("bigint").alias("words"),
        F.count(F.lit(1)).alias("units"), F.min("first").alias("first"), F.bool_or("firm").alias("firm"))
    return spans.filter(F.col("firm") & (F.col("words") >= run_words)).select(
        "doc", "mark", F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint"), "words", "units", "first")


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """The spans to remove, one row each: `doc_id`, `span_start`, `span_end` (code points of the original text),
    `words`, `units`, `first_doc_id` (lowest id that keeps one of the span's units).

    A unit is kept where it occurs first: in the document of the smallest id (of the texts of one id, in that of the lower
    hash), at its first place there. Its other occurrences are repeats. Repeats that follow one another without a break
    are one span. A span goes, however short, if it holds a whole line or a sentence of FRAGMENT_WORDS words; fragments
    alone (one or two words that a mark inside a line ends) stay, as they repeat by chance. A caller may spare
    spans of fewer than `run_words` words. Null and empty texts have no units. Different texts of one id, or without an
    id, are documents of their own; rows without an id rank last; rows that are equal in id and text are one document, whose
    copies keep what they share. An empty table gives no rows.

    Counting per digest is combined before the shuffle and the join back splits digests with many occurrences, so a line
    that a third of all documents hold is no task of its own.
    """
    no_id = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return _spans(documents, id_col, text_col, run_words).select(
        no_id("doc").alias("doc_id"), "span_start", "span_end", "words", "units", no_id("first").alias("first_doc_id"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans; the white space before a removed span goes with it."""
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept.append(text[at:start].rstrip() if start else "")
        at = max(at, stop)
    return "".join([*kept, text[at:]])


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """All documents with their columns, the text without its repeated spans, and `removed_spans`, an array of
    struct(span_start, span_end) in the original text (empty if nothing is removed). Spans belong to a text and its id, so a
    row loses only what was found in its own text."""
    spans = _spans(documents, id_col, text_col, run_words)
    lists = spans.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(
        F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("removed_spans"))
    rows = documents.select(packed(documents), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("_doc"),
                            F.xxhash64(whole(F.col(text_col))).alias("_mark"))
    joined = rows.join(lists, ["_doc", "_mark"], "left")
    spans_of = F.coalesce("removed_spans", F.array().cast("array<struct<span_start:bigint,span_end:bigint>>"))

    @F.pandas_udf(T.StringType())
    def cut(texts, lists):
        import pandas as pd

        return pd.Series([t if t is None else cut_spans(t, [(s["span_start"], s["span_end"]) for s in found])
                          for t, found in zip(texts, lists)], dtype=object)

    joined = joined.withColumn("removed_spans", spans_of)
    text = cut(F.col(f"_row.`{text_col}`"), F.col("removed_spans"))
    columns = [text.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in documents.columns if c != "removed_spans"]
    return joined.select(*columns, "removed_spans")
