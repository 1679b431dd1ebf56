"""The corpus operators against plain versions: brute force, exact round trips, held-out accuracy."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from math import comb

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tripwise.checks.compare import compare, oracle_connection
from tripwise.llm import (
    decontamination, edit_fingerprints, html_extraction, line_dedup, mixing, queries, sharding, simhash, token_counts,
)
from tripwise.llm.graph import components
from tripwise.operators.staging import materialize

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def table(name, folder=SMALL):
    return duckdb.sql(f"select * from '{folder}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in sorted(table("documents"))}


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size int, fingerprint string, _key int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the names of results."""
    long = "word soup, again. " * 4000
    rows = [(1, "a b c d e", "en", "x", 9, "s", 1, "f", 1), (1, "a b c d e", "en", "x", 9, "s", 1, "f", 1),
            (2, None, None, None, None, None, None, None, None), (3, "", "en", "y", 0, "s", 1, "f", 1), (None, "a b c d e", "en", None, 9, "s", 1, "f", 1),
            (None, None, None, None, None, None, None, None, None), (4, long, "en", "x", len(long), "s", 1, "f", 1),
            (5, " \n\t ", "en", "x", 4, "s", 1, "f", 1), (6, "ünï 😀 A B", "en", "", 9, "s", 1, "f", 1), (7, long, "en", "z", 1, "s", 1, "f", 1)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


@pytest.mark.parametrize("key", list(queries.ORACLES))
def test_query_equals_oracle(spark, key):
    assert compare(spark, oracle_connection(SMALL), queries.QUERIES[key], queries.ORACLES[key], SMALL) == []


# 1 token counts

def test_tree_follows_random_edits():
    counts, rng = token_counts.piece_counts(token_counts.VOCABULARY), random.Random(3)
    letters = "ab  \n'sré12,.!ll d"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 300, 3000])))
        tree = token_counts.TokenTree.build(text, counts)
        for _ in range(3):
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 200, 1500])))
            text, tree, _ = token_counts.edit(text, tree, rng.randint(0, len(text) + 3), rng.choice([0, 1, 10, 500]), new, counts)
            assert tree.chars[1] == len(text) and tree.tokens[1] == len(counts.encoding.encode_ordinary(text))


def test_an_edit_behind_an_apostrophe_at_a_leaf_end():
    counts = token_counts.piece_counts(token_counts.VOCABULARY)
    for lead in range(2 * token_counts.LEAF + 2):
        text = " a" * lead + "'lx end"
        tree = token_counts.TokenTree.build(text, counts)
        new, tree, _ = token_counts.edit(text, tree, 2 * lead + 2, 1, "l", counts)
        assert tree.tokens[1] == len(counts.encoding.encode_ordinary(new))


def test_edited_counts_equal_whole_encoding(spark, texts):
    encoding = token_counts.piece_counts(token_counts.VOCABULARY).encoding
    found = {r["doc_id"]: r for r in queries.op1_token_counts(spark, SMALL).collect()}
    assert found.keys() == texts.keys()
    for doc, t in texts.items():
        n = len(t)
        new = t[:n // 3] + t[:60] + t[n // 3 + n // 20:]
        new = new[:n // 2] + ", as amended in 2024," + new[n // 2:]
        r = found[doc]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (len(encoding.encode_ordinary(t)), len(encoding.encode_ordinary(new)), len(new))
    assert sum(r["encoded_again"] for r in found.values()) < 0.6 * sum(r["pieces"] for r in found.values())


def test_edits_from_a_table(spark, odd):
    edits = spark.createDataFrame([(3, 1, 0, 0, "hello there"), (6, 2, 99, 5, None), (6, 1, 0, 3, "x")],
                                  "doc_id bigint, nth int, start bigint, length bigint, replacement string")
    rows = token_counts.recount(token_counts.token_trees(token_counts.with_edits(odd, edits), F.col("edits"))).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["edited_chars"] for r in rows if r["doc_id"] in (2, 3, 6)} == {2: 0, 3: 11, 6: 7}


# 2 fingerprints

def slow_fingerprint(text):
    one, embedding, at = edit_fingerprints._moves()[0], [], 0
    for ch in text:
        step = (int(one[((ord(ch) * 2654435761) & 0xFFFFFFFF) >> 28][at % 256]) - at) % 256
        embedding += [ord(ch)] * step
        at += step
    level = edit_fingerprints._level(at)
    out = ""
    for p, salt in zip(edit_fingerprints._positions(level).tolist(), edit_fingerprints._salts(level).tolist()):
        if p < at:
            mixed = ((embedding[p] ^ salt) * 0x9E3779B1) & 0xFFFFFFFF
            out += "0123456789abcdef"[(((mixed ^ (mixed >> 15)) * 0x85EBCA77) & 0xFFFFFFFF) >> 28]
    return f"{at:x}:{out}"


def test_fingerprint_equals_the_plain_walk():
    rng = random.Random(2)
    for n in [*range(30), 333, 5001, 60000]:
        text = "".join(rng.choice("abc déß😀\n") for _ in range(n))
        assert edit_fingerprints.fingerprint(text) == slow_fingerprint(text)


def test_fingerprints_of_edited_texts(spark, texts):
    found = {r["doc_id"]: r for r in queries.op2_edit_fingerprints(spark, SMALL).collect()}
    ids = list(texts)
    for i, doc in enumerate(ids):
        text, following = texts[doc], texts[ids[(i + 1) % len(ids)]]
        new = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        r = found[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == edit_fingerprints.fingerprint(text) and r["edited_fingerprint"] == edit_fingerprints.fingerprint(new)
    apart = [r for r in found.values() if r["near_next"] < 0.9 and r["n_chars"] > 200]
    assert np.mean([r["near_edited"] > r["near_next"] for r in apart]) > 0.99


def test_fingerprints_of_odd_rows(odd, nothing):
    rows = edit_fingerprints.fingerprint_edits(odd).collect()
    assert len(rows) == 10 and {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"0:"}
    assert edit_fingerprints.fingerprint_edits(nothing).count() == 0
    groups = {r["doc_id"]: r["group_id"] for r in edit_fingerprints.near_groups(odd).collect() if r["doc_id"] is not None}
    assert groups[4] == groups[7] == 4 and groups[2] == groups[3] == 2 and groups[1] == 1


def edited_copies():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    opening, out = " ".join(word() for _ in range(70)), []
    for _ in range(8):
        rest = [word() for _ in range(30)]
        for _ in range(10):
            out.append(" ".join([opening, *(word() if rng.random() < 0.3 else w for w in rest)]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("together", [2000, 20])
def test_groups_of_edited_copies_equal_all_pairs_of_each_band(spark, monkeypatch, together):
    monkeypatch.setattr(edit_fingerprints, "TOGETHER", together)
    docs = dict(enumerate(edited_copies()))
    prints = {i: edit_fingerprints.fingerprint(t) for i, t in docs.items()}
    keys, label = {i: set(edit_fingerprints.bands(p)) for i, p in prints.items()}, {i: i for i in docs}
    alike = [(i, j) for i in docs for j in range(i) if keys[i] & keys[j] and edit_fingerprints.likeness(prints[i], prints[j]) >= 0.8]
    for _ in docs:
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    rows = edit_fingerprints.near_groups(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == label and 1 < len(set(label.values())) < len(docs)


# 3 mixing

def test_splitting_tree_deals_out_every_block(spark):
    quota = [2048, 700, 0, 33, 1]
    rows = mixing.split_quotas(spark.createDataFrame([(quota,)], "quota array<bigint>"), 4).collect()
    assert len(rows) == 16 and [sum(q) for q in zip(*[r["quota"] for r in rows])] == quota
    assert max(sum(r["quota"]) for r in rows) - min(sum(r["quota"]) for r in rows) <= 1
    # the largest source is spread as the law says: mean 128, deviation about 5.7
    assert all(95 < r["quota"][0] < 160 for r in rows)


def test_hypergeometric_follows_its_law(spark):
    got = spark.range(2000).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(6), (F.col("id") + 0.5) / 2000).alias("x"))
    seen = Counter(r["x"] for r in got.collect())
    for x in range(7):
        assert abs(seen[x] / 2000 - comb(8, x) * comb(12, 6 - x) / comb(20, 6)) < 0.002


def test_mix_meets_targets_and_draws_disjoint_copies(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = mixing.mix_table(docs).collect()
    taken, target, source = Counter(), {}, {r[0]: r[3] for r in table("documents", MIDDLE)}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1
    copies = Counter((r["doc_id"]) for r in mixing.mix(docs).select("row.doc_id", "shard").collect())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["size"]}
    assert all(copies[d] == n for d, n in want.items())


def test_mixing_odd_rows(odd, nothing):
    rows = mixing.mix_table(odd).collect()
    assert len(rows) == 10 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_table(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert mixing.local_shuffle(mixing.mix(odd), 2).count() == mixing.mix(odd).count()


# 4 decontamination

def test_exact_passages_are_found_and_clean_documents_left(spark):
    items, docs = table("benchmark", MIDDLE), table("documents", MIDDLE)
    inside = {(d[0], i[0]) for d in docs for i in items if i[1] in d[1]}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, MIDDLE).collect()}
    assert inside <= found and len(found - inside) <= 0.03 * len(inside)


def test_paraphrase_and_answer(spark):
    item = "The quick brown fox jumped over seven lazy dogs near the old stone bridge. The answer is forty two bananas."
    said = "Well: the quick red fox jumped right over seven lazy dogs near an old stone bridge; the answer is forty two bananas, they say"
    other = "The quick brown fox jumped over seven lazy dogs near the old stone bridge while nobody knew anything else about it at all"
    docs = spark.createDataFrame([(1, said), (2, other), (3, None), (4, ""), (5, "nothing to see here at all"), (1, said)] +
                                 [(i, f"filler text number {i} about the weather and the sea") for i in range(10, 60)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "x")], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()) == [(1, 7), (1, 7)]
    assert decontamination.keep_clean(docs, bench).count() == 54
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_items_come_in_order_in_few_jobs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.choice("abc"), rng.choice(["x", None])) for _ in range(90)]
    items = spark.createDataFrame(rows, "item_id bigint, text string, answer string").repartition(30)
    expected = sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 7)
    assert list(decontamination._in_order(items)) == expected
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 1000)
    spark.sparkContext.setJobGroup("items", "items")
    try:
        assert list(decontamination._in_order(items)) == expected
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("items")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_candidates_equal_a_dense_computation():
    """Cosines of whole TF-IDF rows in the latent space; repeated words count by their number, none is passed over."""
    rng = random.Random(9)
    names = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(names) for _ in range(rng.choice([5, 20, 40]))), None) for i in range(8)]
    bench = decontamination.Benchmark.of(items)
    terms = len(bench.numbers)
    weights = np.array([rng.uniform(0.3, 4) for _ in range(terms + 1)])
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(terms, 30)))[0]
    finder = decontamination.Retriever(bench, weights, basis, 0.5, 0.6, 0.5)
    texts = []
    for k in range(120):
        words = [rng.choice(names if rng.random() < 0.6 else ["strange", "other", "odd"]) for _ in range(rng.choice([0, 1, 9, 16, 17, 33, 90]))]
        if k % 3 == 0:
            words = (items[k % 8][1].split() + [rng.choice(names)] * rng.choice([1, 6, 20]))[:rng.choice([12, 32, 60])]
        texts.append(finder.vocabulary.encode(" ".join(words)))
    dense = lambda ids: np.bincount(ids, minlength=terms + 1)[:terms] * weights[:terms]
    latent = [dense(np.array(p)) / np.linalg.norm(dense(np.array(p))) @ basis for p in bench.passages]
    want = {}
    for t, ids in enumerate(texts):
        for at in range(0, max(1, len(ids) - 16), 16):
            passage = ids[at:at + 32]
            length = math.sqrt((dense(passage) ** 2).sum() + (passage == terms).sum() * weights[-1] ** 2)
            for p, row in enumerate(latent):
                cosine = float(dense(passage) @ basis @ row / np.linalg.norm(row) / length) if length else 0.0
                assert cosine < 1 + 1e-9
                key = (t, at, int(bench.item_of[p]))
                if cosine >= 0.5:
                    want[key] = max(cosine, want.get(key, 0))
    found = {}
    for t, at, item, cosine in finder.candidates(texts):
        assert cosine <= 1
        found[(t, at, item)] = max(cosine, found.get((t, at, item), 0))
    sure = {k for k, c in want.items() if c > 0.5 + 1e-5}
    assert len(sure) > 40 and sure <= found.keys() and all(abs(found[k] - want.get(k, 0.5)) < 1e-4 for k in found)


def test_an_item_without_its_last_sentence_is_found_unless_an_answer_is_given(spark):
    item = "The quick brown fox jumped over seven lazy dogs near the old stone bridge and swam home. Nobody knew."
    said = "Well: the quick red fox jumped over seven lazy dogs near the old stone bridge and swam home, they all say"
    docs = spark.createDataFrame([(1, said)] + [(i, f"filler text number {i} about the weather and the sea") for i in range(10, 60)],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item, None), (8, item, "forty two bananas")], "item_id bigint, text string, answer string")
    found = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, answer_col="answer").collect()]
    assert found == [(1, 7)] and decontamination.keep_clean(docs, bench).count() == 50


def test_common_length_is_that_of_the_plain_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.common_length(a, b) == best[-1][-1] == len(html_extraction.aligned(a, b))


# 5 line dedup

def test_spans_equal_brute_force(spark, texts):
    firsts = {}
    for doc in sorted(texts):
        for *_, digest, _ in line_dedup.units(texts[doc]):
            firsts.setdefault(digest, doc)
    want = set()
    for doc, text in texts.items():
        seen, run = set(), []
        for unit in [*line_dedup.units(text), None]:
            if unit and (unit[3] in seen or firsts[unit[3]] < doc):
                run.append(unit)
            else:
                if any(u[4] for u in run):
                    want.add((doc, run[0][0], run[-1][1]))
                run = []
            if unit:
                seen.add(unit[3])
    found = {(r["doc_id"], r["span_start"], r["span_end"]) for r in queries.op5_line_dedup(spark, SMALL).collect()}
    assert found == want and want


def test_repeats_are_cut_and_offsets_kept(spark, odd, nothing):
    line = "This very long notice is found at the foot of each and every page."
    docs = spark.createDataFrame([(1, f"One. {line}\nEnd"), (2, f"Two. {line} More."), (3, None), (3, ""), (None, line)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in line_dedup.remove_repeats(docs).collect()}
    assert rows[1]["text"] == f"One. {line}\nEnd" and rows[2]["text"] == "Two. More."
    start, end = rows[2]["removed_spans"][0]
    assert f"Two. {line} More."[start:end] == line and rows[None]["text"] == ""
    assert line_dedup.remove_repeats(odd).count() == 10 and line_dedup.repeated_spans(nothing).count() == 0


def test_whole_lines_and_sentences_are_firm():
    found = line_dedup.units("Ah. Oh no. This is so.\nHome\n  Hi!  \n\nLast. End")
    assert [(u[2], u[4]) for u in found] == [(1, False), (2, False), (3, True), (1, True), (1, True), (1, False), (1, False)]


def test_texts_that_share_an_id_keep_to_themselves(spark):
    """Spans found in one text are cut from no other text of its id, nor from rows without an id."""
    shared = "A notice that many pages of this place repeat."
    docs = spark.createDataFrame(
        [(1, f"{shared}\nown one"), (2, f"Own words here. {shared}"), (2, "A wholly different text to lose nothing of itself."),
         (None, f"First without id. {shared}"), (None, "Another text without any id, all its own."), (None, f"{shared} Tail without id."),
         (5, f"Twice. {shared}"), (5, f"Twice. {shared}")], "doc_id bigint, text string")
    texts = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.remove_repeats(docs).collect()))
    assert texts == sorted([
        (1, f"{shared}\nown one"), (2, "Own words here."), (2, "A wholly different text to lose nothing of itself."), (0, "First without id."),
        (0, "Another text without any id, all its own."), (0, " Tail without id."), (5, "Twice."), (5, "Twice.")])


def test_short_repeats_go(spark):
    docs = spark.createDataFrame([(1, "Home\nFirst own text here.\nAll rights reserved."), (2, "Home\nSecond own text. It is so.\nAll rights reserved."),
                                  (3, "Third own text. It is so. More of it.\nhome")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in line_dedup.remove_repeats(docs).collect()}
    assert [rows[i]["text"] for i in (1, 2, 3)] == [docs.collect()[0]["text"], "\nSecond own text. It is so.", "Third own text. More of it."]


# 6 and 9 classifiers

def ranked_right(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1
    good = np.asarray(truth) == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("query, column, least", [("op6_toxicity", 2, 0.85), ("op9_pu_quality", 1, 0.98)])
def test_held_out_accuracy(spark, query, column, least):
    labels = {r[0]: r[column] for r in table("labels", MIDDLE)}
    rows = queries.QUERIES[query](spark, MIDDLE).collect()
    assert len(rows) == len(table("documents", MIDDLE))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert ranked_right([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) > least


@pytest.mark.parametrize("query", ["op6_toxicity", "op9_pu_quality"])
def test_classifiers_on_odd_rows(spark, odd, nothing, query):
    from tripwise.llm import pu_quality, toxicity

    run = {"op6_toxicity": toxicity.toxicity_table, "op9_pu_quality": pu_quality.quality_table}[query]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (1, None, None), (1, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    assert run(odd, labels).count() == 10 and run(odd, labels.limit(0)).count() == 10 and run(nothing, labels).count() == 0


# 7 pages

def test_pages_give_their_articles(spark):
    docs = [" ".join(t.split()) for t in (r[1] for r in table("documents"))]
    rows = queries.op7_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(table("pages"))
    for r in rows:
        body = " ".join(r["text"].split("\n")[1:])  # the first line is the heading
        assert body in docs and r["n_chars"] == len(r["text"])


def test_shared_lines_go_where_nothing_marks_the_article(spark):
    def page(body):
        return f"<div>Menu of the whole site</div><p>{body} &amp; more</p><p>Our long address line</p><div class='ad'>buy</div><script>x='<p>no</p>'</script>"

    rows = [(1, "http://h/a/1", page("First own text" + " goes on" * 20)), (2, "http://h/a/2", page("Second own text" + " goes on" * 20)), (3, "http://h/a/3", page("Second own text" + " goes on" * 20)),
            (4, None, None), (5, "http://alone/x", page("Alone")), (6, "bad url", ""), (None, "http://h/a/9", page("Third" + " goes on" * 20))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    for key, start in ((1, "First own text"), (2, "Second own text"), (3, "Second own text"), (None, "Third")):
        assert found[key] == start + " goes on" * 20 + " & more"
    assert found[4] == found[6] == "" and found[5] == "Menu of the whole site\nAlone & more\nOur long address line"
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0


def test_lines_that_most_articles_of_a_host_hold_go_and_quotes_stay(spark):
    def page(i):
        quote = "<p>As the old saying has it</p>" if i in (3, 4) else ""
        own = f"<p>Own text number {i}" + " goes on" * 20 + "</p>"
        return f"<nav>Menu</nav><article><p>Read this in our app today</p>{own}{quote}<p>Written by our staff</p></article>"

    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(1, 8)] + [(i, f"http://two/{i}", page(i)) for i in (8, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"].split("\n") for r in html_extraction.extract_pages(pages).collect()}
    own = {i: f"Own text number {i}" + " goes on" * 20 for i in range(1, 10)}
    assert all(found[i] == [own[i]] + ["As the old saying has it"] * (i in (3, 4)) for i in range(1, 8))
    assert all(found[i] == ["Read this in our app today", own[i], "Written by our staff"] for i in (8, 9))  # too few pages to tell


def test_partners_are_found_past_any_number_of_copies(spark, monkeypatch):
    """Against a plain search over the whole host; blocks of three pages, so that every search crosses many of them."""
    rng = random.Random(3)

    def page(i):
        body = [f"Tale number {i % 5}, told by line {k}" for k in range(6)] if i < 40 else [f"Own line {i} {k}" for k in range(6)]
        body[rng.randrange(6)] = f"Altered in {i % 30}"
        return "".join(f"<p>{line}</p>" for line in ["Menu of the site", f"Part {i % 3}", *body, "Our address"])

    paths = [f"/{'a' * rng.randrange(3)}/{i:02d}" for i in range(48)]
    rows = [(i, f"http://h{i % 2 if i < 10 else 0}{paths[i]}", page(i)) for i in range(48)] + [(99, "http://h0/zz", page(47))]

    def plain(i):
        own = html_extraction.lines_of(rows[i][2])
        digests, weights = [line.digest for line in own], [len(line.text) for line in own]
        order, seen = [], set()
        for at, r in sorted(enumerate(rows), key=lambda x: (x[1][1], x[1][0])):
            lines = tuple(line.digest for line in html_extraction.lines_of(r[2]))
            if r[1].startswith(rows[i][1][:9]) and lines not in seen:
                seen.add(lines)
                order.append((r[1], lines))
        me = next(k for k, (_, lines) in enumerate(order) if list(lines) == digests)
        for k in sorted(range(len(order)), key=lambda k: (-html_extraction._shared_path(order[me][0], order[k][0]), abs(k - me), k)):
            found = html_extraction.aligned(digests, list(order[k][1]))
            if 2 * sum(weights[f] for f in found) <= sum(weights):
                return "\n".join(line.text for j, line in enumerate(own) if j not in found)
        return "\n".join(line.text for line in own)

    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    monkeypatch.setattr(html_extraction, "PAGES_AT_ONCE", 3)
    found = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    assert found == {r[0]: plain(i) for i, r in enumerate(rows)}
    same = [(i, f"http://h/a/{i:02d}", page(40).replace("Menu", f"Menu {i}:")) for i in range(30)] + [(30, "http://h/b", page(41))]
    found = html_extraction.extract_pages(spark.createDataFrame(same, "page_id bigint, url string, html string")).collect()
    assert len(found) == 31 and not any("Our address" in r["text"] for r in found)


def test_the_nearest_page_is_found_on_a_large_host(spark):
    def page(i):
        return f"<p>Section {i // 2}</p><p>The own and only text of page {i}</p>"

    rows = [(i, f"http://h/{i // 2:04d}/{i}", page(i)) for i in range(2400)]
    found = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in found) == [(i, f"The own and only text of page {i}") for i in range(2400)]


def test_alignment_is_a_common_subsequence_and_bounded():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 9, 50])) for _ in range(rng.randrange(0, 700))] for _ in range(2))
        found = sorted(html_extraction.aligned(a, b))
        rest = iter(b)
        assert all(a[i] in rest for i in found) and len(found) == decontamination.common_length(a, b)
    start = time.monotonic()
    assert len(html_extraction.aligned([0] + [1] * 20_000, [1] * 19_000 + [2])) == 19_000
    assert len(html_extraction.aligned([1, 2] * 10_000, [2, 1] * 10_000 + [3])) == 19_999
    assert time.monotonic() - start < 30


def test_every_article_line_of_the_given_pages_stays(spark):
    """No given page repeats a line over most articles of its host, so all lines of the marked articles are text."""
    found = {r["page_id"]: r["text"] for r in queries.op7_html_extraction(spark, MIDDLE).collect()}
    pages = table("pages", MIDDLE)
    assert len(found) == len(pages)
    for page_id, _, page in pages:
        assert found[page_id] == "\n".join(line.text for line in html_extraction.lines_of(page) if line.article)


def test_pages_odd_in_every_way(spark):
    long = "<article>" + "<p>same line</p>" * 5000 + "<p>end</p></article>"
    rows = [(1, "http://h/a", long, "x", 1, "t"), (2, "http://h/b", long.replace("end", "stop"), "x", 1, "t"), (2, "http://h/b", long, None, None, None),
            (None, None, None, None, None, None), (3, "http://h/", "", "x", 1, "t"), (4, "//", "<p>a<b>b", "x", 1, "t"), (5, "http://h/é", "\x00<article>ü&nbsp;😀", "x", 1, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, slot int, text string")
    found = html_extraction.extract_pages(pages).collect()
    assert len(found) == 7 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert sum(r["text"].count("same line") for r in found) == 15_000
    assert {r["page_id"]: r["text"] for r in found}[5] == "ü 😀"


# 8 sharding

def test_shards_are_even_gapless_and_hold_the_mixture(spark):
    rows = queries.op8_sharding(spark, MIDDLE).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in sizes.items() for i in range(n)}
    source = {r[0]: r[3] for r in table("documents", MIDDLE)}
    whole, parts = Counter(source.values()), Counter((r["shard"], source[r["doc_id"]]) for r in rows)
    assert all(abs(parts[s, name] - n / 40) < 2 for s in sizes for name, n in whole.items())


def test_sharding_odd_rows(odd, nothing):
    rows = sharding.assign_shards(odd, 3).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [3, 3, 4] and sharding.assign_shards(nothing, 3).count() == 0
    assert sharding.shard_table(odd.select("doc_id", "text", "source"), 40).count() == 10


def test_sources_of_one_row_spread_over_ranges(spark, monkeypatch):
    """60,000 sources of one row all have the fractional rank 1/2; beside them one large source."""
    rows = spark.range(80_000).selectExpr("id as doc_id", "'t' || id % 7 as text", "if(id < 60000, 's' || id, 'large') as source")
    written, write = [], sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, label: written.append((label, write(df, label))) or written[-1][1])
    out = sharding.shard_table(rows, 7).collect()
    ranges = [r["n"] for label, df in written if label == "places" for r in df.groupBy("_at").agg(F.count("*").alias("n")).collect()]
    assert len(ranges) == 8 and max(ranges) < 2 * 10_000
    key = {r["doc_id"]: r["key"] for r in rows.select("doc_id", sharding.seeded_key(sharding.SEED, F.col("doc_id"), F.md5("text")).alias("key")).collect()}
    place = {d: i for i, d in enumerate(sorted(range(60_000, 80_000), key=key.get))}
    order = sorted(range(80_000), key=lambda d: (0.5, f"s{d}") if d < 60_000 else ((2 * place[d] + 1) / 40_000, "large"))
    assert [d for _, _, d in sorted((r["shard"], r["slot"], r["doc_id"]) for r in out)] == order


# 10 near duplicates

def test_covering_masks_hide_every_small_difference():
    masks, rng = [m & (2**64 - 1) for m in simhash.covering_masks()], random.Random(1)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), 4):
            b ^= 1 << i
        assert any(a & m == b & m for m in masks)


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by comparing all pairs."""
    ids, values = list(prints), np.array(list(prints.values()), np.uint64)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= 4):
            a, b = sorted((root(i), root(ids[k + 1 + int(j)])))
            label[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_all_pairs(spark):
    prints = {r[0]: plain_simhash(r[1]) for r in sorted(table("documents"))}
    rows = queries.op10_simhash(spark, SMALL).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{v:016x}" for d, v in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)


def test_links_of_dense_and_sparse_values_equal_all_pairs(spark):
    rng, values = random.Random(8), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            v = centre
            for i in rng.sample(range(64), rng.randrange(6)):
                v ^= 1 << i
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in enumerate(sorted(values))}
    frame = spark.createDataFrame([(i, v) for i, v in signed.items()], "doc_id bigint, value bigint")
    found = {r["doc_id"]: r["component_id"] for r in simhash._with_components(frame, 4).collect()}
    assert found == plain_components(dict(enumerate(sorted(values))))


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {2}
    kept = simhash.drop_near_duplicates(odd).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 4, 6] and list(kept[0].asDict()) == odd.columns
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_every_step_of_the_star_rounds_is_one_join(spark):
    from tripwise.llm import graph

    edges = spark.createDataFrame([(i + 1, i) for i in range(9)] + [(9, 0)], "u bigint, v bigint")
    larger = graph._large_star(edges)
    joins = [str(f._jdf.queryExecution().optimizedPlan()).count("Join ") for f in (larger, graph._small_star(larger.limit(99)))]
    scans = [str(f._jdf.queryExecution().optimizedPlan()).count("LogicalRDD") for f in (larger, graph._small_star(edges))]
    assert joins[0] == 1 and scans == [2, 2]
    assert {tuple(r) for r in graph._small_star(edges).collect()} == {(i, min(i - 1, 0 if i == 9 else i - 1)) for i in range(1, 10)} | {(8, 0)}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, None), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(chain, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = {r[0]: r[1] for r in table("labels", MIDDLE)}
    kept, columns = docs, docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, materialize(stage(spark, kept, MIDDLE), name)
        counts[name] = ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name != "shard":
            assert kept.columns == columns
        if name == "quality":
            good = [d for d, q in labels.items() if q == 1]
            assert np.mean([d in set(ids) for d in good]) > 0.99
        if name == "near_duplicates":
            prints = {r["doc_id"]: plain_simhash(r["text"]) for r in before.select("doc_id", "text").collect()}
            assert sorted(ids) == sorted(set(plain_components(dict(sorted(prints.items()))).values()))
        if name == "decontaminate":
            items = [i[1] for i in table("benchmark", MIDDLE)]
            assert not any(i in r["text"] for r in kept.select("text").collect() for i in items)
    assert counts["shard"] and sorted(counts["shard"]) == sorted(counts["mix"])
    assert corpus_pipeline.run(spark, SMALL).count() > 0
