"""Hard negatives and vector codes against plain loops over all pairs."""

import math
import random

import numpy as np
import pytest

from colscope.llm import codes, negatives

DDL = "vec_id long, embedding array<float>, label int, vector string, slice int, n long"


def rows_of(n, width, seed, labels=3, coarse=8):
    """Coarse components, so that scores and distances tie often."""
    rng = random.Random(seed)
    return [(i, [rng.randint(-coarse, coarse) / coarse for _ in range(width)], rng.randrange(labels), "x", 1, 1) for i in range(n)]


def odd_rows():
    rows = rows_of(260, 8, 3)
    rows[5] = (5, None, 1, None, None, None)
    rows[6] = (6, [0.5, None] + [0.25] * 6, 1, "x", 1, 1)
    rows[7] = (7, [float("nan")] + [0.1] * 7, 0, "x", 1, 1)
    rows[8] = (8, [float("-inf")] + [0.1] * 7, 0, "x", 1, 1)
    rows[9] = (9, rows[9][1], None, "x", 1, 1)
    rows[10] = (10, rows[11][1], 2, "x", 1, 1)
    rows[12] = (12, [0.0] * 8, 1, "x", 1, 1)
    rows[50] = (50, [0.0] * 8, 1, "x", 1, 1)
    rows[100] = (100, [0.5] * 3, 1, "x", 1, 1)
    rows[101] = (101, [0.5] * 11, 2, "x", 1, 1)
    return rows + [rows[20], rows[20], (-50, [0.25] * 8, 0, "x", 1, 1)]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, scale=256):
    kept = []
    for i, v, label, *_ in rows:
        if label is None or not sound(v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(scale * float(np.float32(x))) for x in v]))
    width = max((len(v) for i, _, v in kept if i % 50 == 0), default=0)
    out, done = set(), set()
    for a, label, v in sorted(kept):
        if a % 50 or a in done:
            continue
        done.add(a)
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept]
        positives = sorted((s, i) for s, i, other in scored if other == label and i != a)[:5]
        for s, p in positives:
            window = sorted((t, i) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(window, 1)}
    return out


def mined(spark, rows, tmp, partitions=3):
    spark.createDataFrame(rows, DDL).repartition(partitions).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    return [tuple(r) for r in negatives.op12_negatives(spark, str(tmp)).collect()]


@pytest.mark.parametrize("make", [odd_rows, lambda: rows_of(400, 5, 7, labels=2, coarse=2), lambda: rows_of(120, 6, 8, labels=12, coarse=50)])
def test_negatives_against_all_pairs(spark, tmp_path, make):
    rows = make()
    got = mined(spark, rows, tmp_path)
    assert set(got) == plain_negatives(rows)


def test_negatives_in_small_blocks_and_slices(spark, tmp_path, monkeypatch):
    rows = rows_of(700, 4, 9, labels=3, coarse=3)
    monkeypatch.setattr(negatives, "SLICE_BYTES", 200)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert set(mined(spark, rows, tmp_path, 2)) == plain_negatives(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_negatives_of_nothing_and_of_large_components(spark, tmp_path):
    assert mined(spark, [], tmp_path / "a", 1) == []
    assert mined(spark, [(3, [1.0], 1, "x", 1, 1)], tmp_path / "b", 1) == []
    assert mined(spark, [(None, [1.0], 1, "x", 1, 1), (50, [1.0], 1, "x", 1, 1), (None, [0.75], 2, "x", 1, 1)], tmp_path / "d", 1) == [
        (50, None, 1, None, 256 * 256, 192 * 256)]
    rows = [(i, [3.0e5 * (i % 5 + 1), -2.0e6 + i], i % 2, "x", 1, 1) for i in range(60)]
    assert set(mined(spark, rows, tmp_path / "c", 2)) == plain_negatives(rows)


def test_search_stops_before_the_end():
    """Rows that can't be among the best are never scored where a few lists decide."""
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 5, (4096, 3))
    x[:, 0] = np.arange(4096)
    anchors = negatives.Anchors(np.array([0]), np.array([1]), np.array([[100, 1, 1]]), [[(0, None, None)]])
    block = negatives.Block(np.arange(1, 4097), np.ones(4096, np.int64), x, anchors)
    read = []
    rounds = block.rounds
    block.rounds = lambda i: (read.append(int(t.sum())) or (t, th) for t, th in rounds(i))
    best = [None]
    negatives.threshold_search(block, anchors, 0, True, 5, best)
    scores = x @ np.array([100, 1, 1])
    assert list(best[0][1]) == list(np.lexsort((np.arange(4096), -scores))[:5] + 1)
    assert sum(read) < 400


def plain_codes(rows, rounds=4):
    kept = [(i, label, v) for i, v, label, *_ in rows if sound(v)]
    width = max((len(v) for *_, v in kept), default=0)
    x = np.zeros((len(kept), width), object)
    for r, (*_, v) in enumerate(kept):
        for j, c in enumerate(v):
            x[r, j] = math.floor(1024 * float(np.float32(c)))
    parts = np.array_split(np.arange(width), 4)
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0], kept[r][2]))[:256]
    books = [[list(x[r, p]) for r in order] for p in parts]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(x[r, p], b) for p, b in zip(parts, books)] for r in range(len(kept))]
        if turn < rounds:
            for q, p in enumerate(parts):
                for k in {f[q][1] for f in found}:
                    members = [r for r in range(len(kept)) if found[r][q][1] == k]
                    books[q][k] = [sum(x[r, j] for r in members) // len(members) for j in p]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, label, _), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    text = ",".join(str(c) for b in books for e in b for c in e)
    import hashlib

    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, total[label], sha) for (i, label, _), f, e in zip(kept, found, errors))


def coded(spark, rows, tmp):
    spark.createDataFrame(rows, DDL).repartition(3).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    return sorted((str(r[0]), *r[1:]) for r in codes.op13_codes(spark, str(tmp)).collect())


@pytest.mark.parametrize("make", [odd_rows, lambda: rows_of(30, 8, 4), lambda: rows_of(300, 6, 5, coarse=2),
                                  lambda: [(i, [1e9 * (i % 3), -3e8 * i, 2.5, 1e-9], None, "x", 1, 1) for i in range(20)]])
def test_codes_against_all_entries(spark, tmp_path, make):
    rows = make()
    assert coded(spark, rows, tmp_path) == plain_codes(rows)


def test_codes_of_nothing(spark, tmp_path):
    assert coded(spark, [], tmp_path) == []
    assert coded(spark, [(1, None, 1, "x", 1, 1)], tmp_path) == []


def test_box_holds_what_is_near():
    rng = np.random.default_rng(2)
    book = rng.integers(-40, 40, (256, 5)).astype(np.int64)
    x = rng.integers(-60, 60, (300, 5)).astype(np.int64)
    s = codes.Slices(book)
    bits = np.unpackbits(s.box(x, np.full(300, 20)).view(np.uint8), axis=1, bitorder="little")[:, :256].astype(bool)
    assert (bits == (np.abs(x[:, None, :] - book[None]) <= 20).all(2)).all()
    d2 = ((x[:, None, :] - book[None]) ** 2).sum(2)
    entry, distance = s.nearest(x)
    assert (entry == d2.argmin(1)).all() and (distance == d2.min(1)).all()
