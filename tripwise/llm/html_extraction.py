"""Main text of web pages by differencing each page with the page of the nearest URL on its host."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwise.llm.common import whole
from tripwise.operators.staging import as_lookup, lookup_join, materialize

PAGES_AT_ONCE = 500
ROWS_PER_BATCH = 1000
ROW_BITS = 33  # of Spark's increasing ids, below the number of the partition
COPY_SHARE = 0.5
SEVERAL = 3
STEP = 256

LINE_COLUMNS = ("page_id bigint, url string, host string, path string, text string, own array<bigint>, weights array<int>, able array<int>, "
                "kind string")
LINES = [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("text", pa.string()),
         ("own", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32())), ("able", pa.list_(pa.int32())), ("kind", pa.string())]
PARTNER_COLUMNS = "host string, kind string, n bigint, way int, partner bigint, shared int, drop array<int>"
PARTNERS = [("host", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("way", pa.int32()), ("partner", pa.int64()),
            ("shared", pa.int32()), ("drop", pa.list_(pa.int32()))]

# Element names of HTML and words that mark the parts of a page.
RAW = frozenset("script style noscript template svg iframe object canvas audio video select textarea button math".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
                  "table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("nav footer aside form dialog menu head title fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
                         "cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices "
                         "pagination popup promo related share sharing sidebar signup social sponsor sponsored subscribe toolbar "
                         "widget".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_MARKS = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z]+")


@dataclass(frozen=True)
class Line:
    text: str
    article: bool  # inside what the page marks as its article
    digest: int


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in CHROME or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for mark in _MARKS.finditer(attributes):
        value = next((v for v in mark.group(2, 3, 4) if v is not None), "").lower()
        kind = mark.group(1).lower()
        if kind == "hidden" or (kind == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")):
            return True
        if kind in ("class", "id") and not CHROME_WORDS.isdisjoint(_PARTS.split(value)):
            return True
    return False


def lines_of(page: str | None) -> list[Line]:
    """The text blocks of a page in order, without markup, scripts, styles and what the page marks as not its content.

    Character references are decoded, white space inside a block becomes one space. An element that is left out but never
    closed ends at the next article.
    """
    page = page or ""
    lower = page.lower()
    lines, words, at = [], [], 0
    articles, skipped, depth = 0, "", 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            lines.append(Line(text, articles > 0, int.from_bytes(digest, "little", signed=True)))

    while True:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else len(page)
        if not skipped and stop > at:
            words.append(page[at:stop])
        if tag is None:
            break
        at = tag.end()
        if tag.group(2) is None:
            continue
        closing, name, attributes = tag.group(1) == "/", tag.group(2).lower(), tag.group(3)
        if skipped:
            if name == skipped and name not in VOID and not attributes.endswith("/"):
                depth += -1 if closing else 1
            if depth == 0:
                skipped = ""
            continue
        if name in RAW:
            if not closing:
                end = lower.find(f"</{name}", at)
                at = page.find(">", end) + 1 if end >= 0 else at
                at = at or len(page)
            continue
        if name in BLOCK:
            flush()
        if closing:
            if name in ("article", "main"):
                articles = max(0, articles - 1)
        elif name in ("article", "main"):
            articles += 1
        elif name not in VOID and not attributes.endswith("/") and _is_chrome(name, attributes, articles > 0):
            if lower.find(f"</{name}", at) >= 0:
                skipped, depth = name, 1
    flush()
    return lines


def aligned(a: list[int], b: list[int]) -> set[int]:
    """Positions in `a` of a longest common subsequence of the two lists.

    Common ends are matched first. The rest is a row of bits for each line of `b`, where a zero marks a position of `a` that
    lengthens the subsequence; the way back through the rows gives the matches. The work is the product of the lengths
    over the bits of a machine word, however often a line repeats. Only every STEP-th row is kept; those between are made
    again on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    inner, other = a[head:len(a) - tail], b[head:len(b) - tail]
    where: dict[int, int] = {}
    for i, value in enumerate(inner):
        where[value] = where.get(value, 0) | 1 << i
    full = (1 << len(inner)) - 1

    def after(row: int, value: int) -> int:
        hit = row & where.get(value, 0)
        return (row + hit | row - hit) & full

    kept, row = [], full
    for j, value in enumerate(other):
        if j % STEP == 0:
            kept.append(row)
        row = after(row, value)
    i, j, block = len(inner) - 1, len(other), []
    while i >= 0 and j > 0:
        if not block:
            start = (j - 1) // STEP * STEP
            block = [kept[start // STEP]]
            for value in other[start:j]:
                block.append(after(block[-1], value))
        if block[-1] >> i & 1:
            i -= 1
            continue
        block.pop()
        j -= 1
        if block[-1] >> i & 1:
            found.add(head + i)
            i -= 1
        if len(block) == 1:
            block = []
    return found


def _shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def judged_lines(page: list[Line], common: frozenset[int]) -> tuple[list[str], list[int], list[int]]:
    """Text of the lines that may be the page's own, their lengths by position (0 for a line that is left out), and the
    positions of those that go if another page shares them.

    Where a page marks its article, everything else is left out. As two articles may quote the same passage, a line inside
    an article can go only if it is among the lines that most articles of the whole host hold (`common`).
    """
    marked = any(line.article for line in page)
    weights = [len(line.text) if line.article or not marked else 0 for line in page]
    able = [i for i, line in enumerate(page) if weights[i] and (not marked or line.digest in common)]
    return [line.text for line, weight in zip(page, weights) if weight], weights, able


def shared_lines(own: list[int], weights: list[int], able: set[int], other: list[int]) -> list[int] | None:
    """Which of the judged lines, counted from 0, go because the other page has them too; None if the other is a copy.

    A page that has more than COPY_SHARE of the page's words in common is a copy, whose common lines are the text itself.
    Common ends that weigh as much tell that without an alignment.
    """
    least = COPY_SHARE * sum(weights)
    if own == other or _common_ends(own, weights, other) > least:
        return None
    found = aligned(own, other)
    if sum(weights[i] for i in found) > least:
        return None
    judged = [i for i, weight in enumerate(weights) if weight]
    return [k for k, i in enumerate(judged) if i in found and i in able]


def _common_ends(own: list[int], weights: list[int], other: list[int]) -> int:
    """Weight of the equal lines at both ends, which every alignment matches."""
    most, head, tail = min(len(own), len(other)), 0, 0
    while head < most and own[head] == other[head]:
        head += 1
    while tail < most - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    return sum(weights[:head]) + sum(weights[len(own) - tail:])


def _article_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest) once for each page that marks its article and each line in it; digest null once for the page."""
    for batch in batches:
        hosts, digests = [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            inside = {line.digest for line in lines_of(page.as_py()) if line.article}
            if inside:
                hosts.extend([host] * (len(inside) + 1))
                digests.extend([None, *inside])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64())], names=["host", "digest"])


def common_lines(rows: DataFrame) -> DataFrame:
    """`host`, `common`: the lines that more than half of the host's marked articles hold, where there are SEVERAL. They are
    fewer than twice the lines of an average article. Counts are combined before the shuffle."""
    counts = materialize(rows.select("host", "html").mapInArrow(_article_lines, "host string, digest bigint").groupBy("host", "digest").agg(
        F.count(F.lit(1)).alias("n")).filter(f"n > {SEVERAL} / 2"), "article-lines")
    pages = counts.filter("digest is null").select("host", F.col("n").alias("pages"))
    often = counts.filter("digest is not null").join(pages, "host").filter(f"pages >= {SEVERAL} and 2 * n > pages")
    return often.groupBy("host").agg(F.array_sort(F.collect_list("digest")).alias("common"))


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of page_id, url, host, path, html, common as rows of LINES. `text` is what stays if no page shares a line;
    `weights` and `able` are null where nothing can go; pages of a `kind` are equal in all that is compared."""
    def made(batch: pa.RecordBatch):
        ids, urls, hosts, paths, pages, commons = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            page = lines_of(pages[i].as_py())
            texts, weights, able = judged_lines(page, frozenset(commons[i].as_py() or ()))
            own = [line.digest for line in page]
            compared = (own, weights, able) if able else (own, None, None)
            kind = hashlib.blake2b(repr(compared).encode(), digest_size=16).hexdigest()
            yield (ids[i].as_py(), urls[i].as_py(), hosts[i].as_py(), paths[i].as_py(), "\n".join(texts), *compared, kind)

    for batch in batches:
        yield from _batches(made(batch), LINES)


def _batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, ROWS_PER_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part), schema)], names=[n for n, _ in schema])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ask the nearest page of its block, in its direction, that is of its host and no copy. Rows are sorted by
    block, the block's pages (in order) before its asks; the lines of one block are held at a time."""
    def found():
        at, places, pages = None, [], []
        for batch in batches:
            for block, way, n, host, path, own, weights, able, kind in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if block != at:
                    at, places, pages = block, [], []
                if way == 0:
                    places.append(n)
                    pages.append((host, path, own))
                    continue
                able = set(able)
                here = range(bisect_left(places, n) - 1, -1, -1) if way < 0 else range(bisect_right(places, n), len(places))
                for i in here:
                    if pages[i][0] != host:
                        break
                    drop = shared_lines(own, weights, able, pages[i][2])
                    if drop is not None:
                        yield host, kind, n, way, places[i], _shared_path(path, pages[i][1]), drop
                        break

    yield from _batches(found(), PARTNERS)


def _in_order(kinds: DataFrame, parts: int) -> DataFrame:
    """Add `n`, the position from 0 in the order of host, path, id and kind: sorted ranges are written, and a range starts
    where those before it end."""
    order = ["host", "path", "page_id", "kind"]
    ordered = kinds.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("_at"), F.monotonically_increasing_id().alias("_nth")), "page-places")
    to_here = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = placed.groupBy(F.col("_at").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_of", F.coalesce(F.sum("_n").over(to_here), F.lit(0)).alias("_before"))
    in_range = F.col("_nth").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), F.col("_at") == F.col("_of")).withColumn("n", F.col("_before") + in_range).drop(
        "_at", "_nth", "_of", "_before")


def lines_to_drop(table: DataFrame) -> DataFrame:
    """`host`, `kind`, `drop`: the judged lines that the nearest page which is no copy has too, for each kind that has one.

    Equal pages of a host are one page, at the lowest of their paths, so a group of copies costs one row. On either side
    in path order the first page that is no copy is the nearest; of the two the one with the longer common path, then the
    nearer. The order of all pages is cut into blocks of PAGES_AT_ONCE, which tasks hold one at a time. Whoever finds only copies
    in a block asks the next one, then the next two, four and so on, up to the end of the host: no page is left out.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hosts = as_lookup(table.filter("able is not null").select("host").distinct(), stage="open-hosts")
    kinds = lookup_join(table, hosts, "host", "left_semi").groupBy("host", "kind").agg(
        F.min(F.struct("path", "page_id")).alias("place"), *[F.first(c).alias(c) for c in ("own", "weights", "able")])
    pages = _in_order(kinds.select("host", "place.path", "place.page_id", "own", "weights", "able", "kind"), parts)
    pages = materialize(pages.select("n", F.floor(F.col("n") / PAGES_AT_ONCE).cast("bigint").alias("block"), "host", "path", "own", "weights", "able", "kind"), "page-order")
    ends = as_lookup(pages.groupBy("host").agg(F.min("block").alias("first"), F.max("block").alias("last")), stage="host-blocks")
    way = F.explode(F.array(F.lit(-1), F.lit(1))).alias("way")
    asks = lookup_join(pages.filter("able is not null"), ends, "host", "inner").select("*", way)
    asks = materialize(asks.withColumn("end", F.when(F.col("way") < 0, F.col("first")).otherwise(F.col("last"))).drop("first", "last"), "asks")

    names, rounds, span = ["block", "way", "n", "host", "path", "own", "weights", "able", "kind"], [], 1
    while not asks.isEmpty():
        until = F.col("block") + F.col("way") * (span - 1)
        until = F.when(F.col("way") < 0, F.greatest(until, "end")).otherwise(F.least(until, "end"))
        each = asks.withColumn("block", F.explode(F.sequence(F.col("block"), until, F.col("way").cast("bigint"))))
        asked = pages.join(each.select("block").distinct(), "block", "left_semi").withColumn("way", F.lit(0))
        dealt = asked.select(names).unionByName(each.select(names)).repartition(parts, "block")
        near = dealt.sortWithinPartitions("block", F.col("way") != 0, "n").mapInArrow(_walked, PARTNER_COLUMNS)
        rounds.append(materialize(near, "partners"))
        asks = asks.join(rounds[-1].select("n", "way").distinct(), ["n", "way"], "left_anti").withColumn("block", F.col("block") + F.col("way") * span)
        asks = materialize(asks.filter(F.col("way") * F.col("block") <= F.col("way") * F.col("end")), "asks")
        span *= 2
    # the first in one direction has the longest path in common there, so the nearest of all is the best of both
    best = F.struct(-F.col("shared"), F.abs(F.col("n") - F.col("partner")), "partner")
    return reduce(DataFrame.unionByName, rounds).groupBy("host", "kind").agg(F.min_by("drop", best).alias("drop"))


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, drops: pd.Series) -> pd.Series:
    def rest(text: str, drop) -> str:
        gone = set(drop)
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([text if drop is None else rest(text, drop) for text, drop in zip(texts, drops)], dtype=object)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    A page is aligned with the nearest page of its host that is no copy of it, however far that is and however large the
    host, and lines that both have are deleted. Pages are parsed where they are read, and those without a line that may go
    are done then; only line digests are sorted and dealt out. Lines that most articles of a host hold are counted over the
    whole host. Null and empty pages give an empty text; pages with a null or malformed URL share one host; a page alone on
    its host is decided by its markup; repeated rows are copies of each other. An empty table gives no rows.
    """
    url = whole(F.col(url_col))
    rows = pages.select(
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), whole(F.col(html_col)).alias("html"))
    joined = lookup_join(rows, as_lookup(common_lines(rows), stage="common-lines"), "host")
    lined = joined.select("page_id", "url", "host", "path", "html", "common").mapInArrow(_lined, LINE_COLUMNS)
    table = materialize(lined, "page-lines")
    undecided = table.filter("able is not null")
    result = table.select("page_id", "url", "text")
    if not undecided.isEmpty():
        drops = as_lookup(lines_to_drop(table), stage="shared-lines")
        rest = lookup_join(undecided, drops, ["host", "kind"]).select("page_id", "url", without_lines("text", "drop").alias("text"))
        result = table.filter("able is null").select("page_id", "url", "text").unionByName(rest)
    return result.withColumn("n_chars", F.char_length("text").cast("bigint"))
