"""Vector codes, centroid clustering and packing against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tripwise.llm import centroids, packing, queries, vector_codes, vectors

SMALL = "/root/testdata/sf0.001"
CLASHING = ("vec_id bigint, embedding array<float>, label int, vector string, cluster int, code string, error int, part int, entry int, "
            "ids int, distance int, dots int, place int, `key` int, n int")


def whole_vectors(rows, scale, width=None):
    """(id, label, integer vector) of the rows that are kept."""
    good = [(i, l, v) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in good if width is None or len(v) == width]


def nearest(points, book):
    apart = ((points[:, None] - book[None]) ** 2).sum(2)
    return apart.argmin(1), apart.min(1)


def moved(points, book, at):
    return np.array([points[at == k].sum(0) // (at == k).sum() if (at == k).any() else book[k] for k in range(len(book))])


def plain_codes(rows, width, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in whole_vectors(rows, 4096, width)), key=lambda r: (r[0] is None, r[0], r[2]))
    points = np.array([r[2] for r in kept]).reshape(len(kept), parts, -1)
    code, error, book_of = np.zeros((len(kept), parts), int), np.zeros(len(kept), int), []
    for p in range(parts):
        book = points[:entries, p]
        for _ in range(rounds):
            book = moved(points[:, p], book, nearest(points[:, p], book)[0])
        code[:, p], apart = nearest(points[:, p], book)
        error += apart
        book_of.append(book)
    by_label = Counter()
    for (_, label, _), e in zip(kept, error.tolist()):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in book_of for x in book.reshape(-1)).encode()).hexdigest()
    return Counter((r[0], "".join(f"{c:02x}" for c in code[k]), int(error[k]), by_label[r[1]], digest) for k, r in enumerate(kept))


def plain_clusters(rows, clusters=40, rounds=5):
    kept = whole_vectors(rows, 256, 64)
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    points = np.array([r[2] for r in kept])
    book = points[:clusters]
    for _ in range(rounds):
        book = moved(points, book, nearest(points, book)[0])
    at, apart = nearest(points, book)
    return Counter((r[0], int(at[k]), int(apart[k]), int(apart[at == at[k]].sum()), int(apart.sum()),
                    hashlib.sha256(",".join(map(str, book[at[k]])).encode()).hexdigest()) for k, r in enumerate(kept))


def odd_vectors(width=64, n=90):
    """Nulls everywhere, bad components, other lengths, ties, repeated rows and ids."""
    rng = random.Random(5)
    some = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(12)]
    rows = [(i, some[i % 12], i % 3 or None) for i in range(n)] + [(7, some[3], 1), (7, some[3], 1), (7, some[4], 2), (None, some[5], None), (None, some[5], 4)]
    rows += [(200, None, 1), (201, [], 1), (202, some[0][:-1], 1), (203, [None] + some[0][1:], 1), (204, [float("nan")] + some[0][1:], 1),
             (205, [float("inf")] + some[0][1:], 1), (206, some[0] + some[0], None), (207, [0.0] * width, 1), (208, [-1e-9] * width, 1)]
    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, "c", 1, 1, 1, 1, 1, 1, 1, 1, 1) for r in rows], CLASHING)


def given():
    return duckdb.sql(f"select vec_id, embedding, label from '{SMALL}/embeddings.parquet'").fetchall()


# 11 vector codes

@pytest.mark.parametrize("seed", range(40))
def test_dual_trees_assign_like_all_distances(seed):
    rng = np.random.default_rng(seed)
    parts, n, m, dim = (int(rng.integers(1, k)) for k in (4, 600, 17, 5))
    spread = int(rng.choice([2, 10, 1000]))
    points = rng.integers(-spread, spread, (parts, n, dim)) + (5 * spread * rng.integers(0, 4, (parts, n, 1)) if seed % 2 else 0)
    book = points[:, rng.integers(0, n, m)] if seed % 3 else rng.integers(-spread, spread, (parts, m, dim))
    trees = vector_codes.Trees.build(points, int(rng.choice([1, 4, 16])))
    found = vector_codes.assign(trees, book)
    want = np.stack([nearest(points[p], book[p])[0] for p in range(parts)])
    assert (vector_codes.codes(trees, found) == want).all()
    counts, totals = vector_codes.entry_sums(trees, found, m)
    for p in range(parts):
        for k in range(m):
            assert counts[p, k] == (want[p] == k).sum() and (totals[p, k] == points[p][want[p] == k].sum(0)).all()


def test_separate_clusters_are_assigned_as_whole_nodes():
    rng = np.random.default_rng(1)
    book = 1000 * np.arange(16).reshape(1, 16, 1) + np.zeros((1, 16, 3), int)
    points = book[:, rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (1, 4000, 3))
    found = vector_codes.assign(vector_codes.Trees.build(points, 16), book)
    assert found.compared < 0.1 * 16 * 4000 and (found.node_stop - found.node_start).sum() > 0.9 * 4000
    assert len(found.node_start) < 400


def test_codes_equal_plain_lloyd(spark):
    assert Counter(map(tuple, queries.op11_vector_codes(spark, SMALL).collect())) == plain_codes(given(), 64)


def test_codes_of_odd_vectors(spark):
    rows = odd_vectors()
    found = vector_codes.compress(frame(spark, rows).repartition(3)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, found.collect())) == plain_codes(rows, 64)


def test_codes_with_fewer_vectors_than_entries(spark):
    rows = odd_vectors(n=2)[:2]
    assert Counter(map(tuple, vector_codes.compress(frame(spark, rows)).collect())) == plain_codes(rows, 64)
    for none in ([], [(1, None, 1), (2, [], 1), (3, [1.0] * 7, 1)]):
        empty = vector_codes.compress(frame(spark, none))
        assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_blocks_of_every_size_give_the_same_codes(spark, monkeypatch):
    rows = given()
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    assert Counter(map(tuple, vector_codes.compress(frame(spark, rows)).collect())) == plain_codes(rows, 64)


# 12 centroid clustering

def test_dots_follow_changed_components():
    rng = np.random.default_rng(2)
    for largest in (100, vectors.LARGEST):
        points, old = rng.integers(-largest, largest, (50, 64)), rng.integers(-largest, largest, (9, 64))
        new = np.where(rng.random((9, 64)) < 0.1, rng.integers(-largest, largest, (9, 64)), old)
        new[3] = old[3]
        dots, moves = points @ old.T, centroids.changes(old, new)
        assert 3 not in [k for k, _, _ in moves] and sum(at.size for _, at, _ in moves) == (old != new).sum()
        centroids.update_dots(points, dots, moves)
        assert (dots == points @ new.T).all()
        if largest == 100:
            assert all((a == b).all() for a, b in zip(centroids.nearest(points, dots, new), nearest(points, new)))


def test_clusters_equal_plain_lloyd(spark):
    assert Counter(map(tuple, queries.op12_centroids(spark, SMALL).collect())) == plain_clusters(given())


def test_clusters_of_odd_vectors(spark):
    rows = odd_vectors()
    assert Counter(map(tuple, centroids.cluster(frame(spark, rows).repartition(3)).collect())) == plain_clusters(rows)
    for none in ([], [(1, None, 1), (2, [1.0] * 63, 1)]):
        empty = centroids.cluster(frame(spark, none))
        assert empty.count() == 0 and "centroid_sha256" in empty.columns


def test_a_component_beyond_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="is beyond"):
        centroids.cluster(frame(spark, [(1, [1e9] * 64, 1)])).collect()


def test_the_generation_before_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "fresh_path", lambda spark, label: f"{tmp_path}/{label}-{len(list(tmp_path.iterdir()))}{random.random()}")
    table = vectors.Generations(spark, "dots")
    df = spark.range(5)
    for _ in range(4):
        df = table.replace(df.selectExpr("id + 1 as id"))
    assert df.agg({"id": "min"}).first()[0] == 4 and len(list(tmp_path.iterdir())) == 1


# 13 packing

def test_tournament_tree_is_first_fit():
    rng = random.Random(4)
    for _ in range(60):
        size, n = rng.choice([8, 100, 2048]), rng.choice([0, 1, 2, 50, 700])
        lengths = np.array([rng.randint(1, rng.choice([size, max(1, size // 5)])) for _ in range(n)], np.int64)
        rooms, want = [], np.zeros(n, int)
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            at = next((b for b, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
            if at == len(rooms):
                rooms.append(size)
            rooms[at] -= int(lengths[i])
            want[i] = at
        assert (packing.first_fit_decreasing(lengths, size) == want).all()


def whole_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_ids_equal_those_of_whole_texts():
    ids, rng = packing.piece_ids(None), random.Random(6)
    letters = "ab '\n\t12.,!é中ß　՘𐐀😀s'll\x1c ̀𝟙"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "x'll y " * 400_000, "z" * 5000, "՘", "\U0001e6c0 a"]
    for text, found in zip(texts, ids.of(texts), strict=True):
        assert found == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ids.unlike


def check_pieces(rows, texts, size=2048):
    """Every id in one piece, right digests, sequences gapless and within bounds; returns tokens and padding."""
    tokenizer = packing.piece_ids(None).tokenizer
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    assert of_doc.keys() == {d for d, _ in texts}
    for doc in of_doc:
        want = Counter()
        for _, text in (t for t in texts if t[0] == doc):
            ids = whole_ids(tokenizer, text)
            for start in range(0, ids.size, size):
                piece = ids[start:start + size]
                want[(start, piece.size, zlib.crc32(piece.tobytes()), ids.size)] += 1
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in of_doc[doc]) == want
    tokens = padding = 0
    for pieces in of_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= size
        tokens, padding = tokens + end, padding + (0 if end.bit_count() == 1 else size - end)
    return tokens, padding


def test_packed_documents(spark):
    texts = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    found = queries.op13_packing(spark, SMALL)
    tokens, padding = check_pieces(found.collect(), texts)
    assert padding < 0.02 * tokens
    row = packing.padding(found).first()
    assert (row["tokens"], row["padding"]) == (tokens, padding)


def test_packing_in_many_groups(spark):
    texts = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_pieces(packing.pack(df, size=512, group=20).collect(), texts, 512)


def test_packing_odd_documents(spark):
    long = "word soup, again. " * 4000
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, None), (3, "", 0), (None, "a b", 1), (None, None, None), (4, long, 1), (5, " \n\t ", 1), (6, long, 2)]
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string, start int").selectExpr(
        "*", "'x' as sequence_id", "1 as length", "2 as offset", "3 as draw", "4 as `group`")
    check_pieces(packing.pack(df).collect(), [(d, t) for d, t, _ in rows * 3])
    assert packing.pack(df.limit(0)).count() == 0
