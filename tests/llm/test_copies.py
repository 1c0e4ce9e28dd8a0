"""Exact copies, near copies, passages, fingerprints and shards against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import exactdedup, fingerprints, neardedup, passages, sharding
from colscope.llm.components import components
from colscope.llm.suffixarray import repeated_windows, suffix_array
from colscope.llm.superminhash import WordHashes, shingles, signatures, similar

SPACES = re.compile("[\x20\x09-\x0d]+")


def test_exact(odd, odd_rows, nothing):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exactdedup.exact_groups(odd, fan_in=2).collect())
    norm = [(i, SPACES.sub(" ", t or "")) for i, t, *_ in odd_rows]
    want = sorted((i, min(j for j, u in norm if u == t), sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert got == want
    kept = exactdedup.drop_copies(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter({k for _, k, _, _ in want})
    assert exactdedup.exact_groups(nothing).count() == 0


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (4, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exactdedup.exact_groups(df).collect()
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in rows) == [
        ("4", 3, False), ("4", 3, False), ("4", 3, True), ("None", 2, False), ("None", 2, True)]


def plain_components(rows):
    known = WordHashes()
    sets = [(i, shingles(t, known)) for i, t in rows]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if similar(sets[a][1], sets[b][1], 75):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sorted((i, len(s), min(sets[k][0] for k in range(len(sets)) if root[k] == root[j])) for j, (i, s) in enumerate(sets))


def test_near(odd, odd_rows, nothing):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardedup.near_groups(odd).collect())
    assert got == plain_components([(i, t) for i, t, *_ in odd_rows])
    kept = neardedup.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})
    assert neardedup.near_groups(nothing).count() == 0


def test_near_chains(spark, words, monkeypatch):
    """Chains of edits and a large group whose members are linked only in part, with few open pairs allowed at once."""
    monkeypatch.setattr(neardedup, "OPEN_PAIRS", 1)
    rng = random.Random(4)
    rows = []
    for g in range(6):
        text = words(80, 100 + g).split()
        for _ in range(25):
            text = list(text)
            for _ in range(2):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardedup.near_groups(df).collect())
    assert got == plain_components(rows)


def test_filters_miss_less_than_the_banding():
    def tail(p, ks, n=128):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in ks)

    banding = (1 - 0.75**4) ** 32
    assert tail(0.75, range(neardedup.AGREE)) < banding  # places that agree
    # of those that don't agree, half differ in a given bit
    assert tail(0.125, range(neardedup.WIDE_APART + 1, neardedup.WIDE + 1), neardedup.WIDE) < banding


def test_signature_estimates(words):
    known = WordHashes()
    a, b = shingles(words(400, 8), known), shingles(" ".join(words(400, 8).split()[:360] + words(40, 9).split()), known)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    one, two, empty = signatures([a, b, a[:0]])
    assert abs((one == two).mean() - truth) < 0.12
    assert (signatures([a, a[:3]])[0] == one).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {60: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(400):
        s = bytes(rng.randrange(97, 97 + rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(1, 70)))
        assert suffix_array(np.frombuffer(s, np.uint8)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023
        if len(s) >= 8:
            valid = np.r_[np.ones(len(s) - 7, bool), np.zeros(7, bool)]
            want = [i for i in range(len(s) - 7) if s[i: i + 8] in {s[j: j + 8] for j in range(i)}]
            assert repeated_windows(np.frombuffer(s, np.uint8), valid, 8).tolist() == want


def plain_removals(rows):
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        covered = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k: k + 100] in seen:
                covered[k: k + 100] = b"\1" * 100
            seen.add(data[k: k + 100])
        kept = bytes(x for x, c in zip(data, covered) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out.append((i, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("together", [20_000, 0])
def test_passages(odd, odd_rows, nothing, together, monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", together)
    monkeypatch.setattr(passages, "SHARD_BYTES", 1000)
    got = sorted(tuple(r) for r in passages.removals(odd).collect())
    assert got == plain_removals(sorted(((i, t) for i, t, *_ in odd_rows), key=lambda x: x[0]))
    cut = passages.remove_passages(odd)
    assert cut.columns == odd.columns and cut.count() == len(odd_rows)
    assert cut.where("doc_id = 1").first().text is None
    assert passages.removals(nothing).count() == 0


def test_passages_unique_ids(spark, words):
    shared = words(40, 20)
    rows = [(i, words(30 + i % 7, 30 + i) + " " + (shared if i % 3 == 0 else "") + " " + words(20, 90 + i) * (1 + i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in passages.removals(df).collect()) == plain_removals(rows)


def test_passages_hot_windows(spark, words, monkeypatch):
    """Windows of anchors with many differing regions, equal or not, never come to the shards' search."""
    def refuse(*_):
        raise AssertionError("a spread-out window was sent to a shard")

    monkeypatch.setattr(passages, "TOGETHER", 0)
    monkeypatch.setattr(passages, "repeated_windows", refuse)
    shared = words(40, 20)
    rows = [(i, words(30 + i % 7, 30 + i) + " " + (shared if i % 3 else "") + " " + words(20, 90 + i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in passages.removals(df).collect()) == plain_removals(rows)


def test_fingerprints(spark, odd, odd_rows, nothing):
    first, piece = fingerprints.FIRST, fingerprints.PIECE
    pieces = lambda t: set(re.findall(rf"(?m)^[^\n]{{1,{first}}}|[^\n]{{1,{piece}}}", t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    unique = {i: t or "" for i, t, *_ in odd_rows if i != 16}  # Java's (?m) also begins a line behind \r
    rows = sorted(unique.items(), reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(pieces(t), pieces(edited))), i
        assert got[i].near_next == pytest.approx(like(pieces(t), pieces(nxt))), i
    assert got[7].fingerprint == got[3].fingerprint != got[12].fingerprint
    assert fingerprints.fingerprint_edits(odd).count() == len(odd_rows)
    assert fingerprints.fingerprint_edits(nothing).count() == 0


def test_shards(spark, odd, odd_rows, nothing):
    df = spark.range(0, 1003, 1, 7).select("id")
    rows = sharding.shard_rows(df, 16, seed=3).collect()
    assert sorted(r.id for r in rows) == list(range(1003))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_rows(odd, 4).count() == len(odd_rows) and sharding.shard_rows(nothing, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(odd, slot_col="lang")


def test_matrix_is_hypergeometric():
    first = Counter(int(sharding.communication_matrix([4, 6], 2, s)[0, 0]) for s in range(4000))
    for k, p in ((0, 5), (1, 50), (2, 100), (3, 50), (4, 5)):  # C(4, k) C(6, 5 - k) / C(10, 5)
        assert first[k] / 4000 == pytest.approx({0: 6, 1: 60, 2: 120, 3: 60, 4: 6}[k] / 252, abs=0.03), p
    m = sharding.communication_matrix([10, 0, 33, 5], 16, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 33, 5] and set(m.sum(axis=0)) == {3}
    big = [sharding.hypergeometric(np.random.default_rng(s), 6 * 10**11, 4 * 10**11, 10**6) for s in range(200)]
    assert abs(np.mean(big) - 6 * 10**5) < 200 and 300 < np.std(big) < 700


def test_queries_whole_tables(spark, folder):
    from colscope.llm.queries import QUERIES

    ids = sorted(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
    shards = QUERIES["op3_shards"](spark, folder).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in shards) == ids
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.grown_shard is None for r in shards)


def test_open_pairs_are_made_once(spark):
    """A pair leaves one of the buckets it shares, and none that is near enough stays behind."""
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        rng = random.Random(i)
        texts.append(" ".join(f"odd{rng.random()}" if rng.random() < 0.015 else w for w in base))
    sets = [shingles(t, WordHashes()) for t in texts]
    marks = signatures(sets)
    nodes = spark.createDataFrame([(i, len(s), m.tobytes(), s.tobytes()) for i, (s, m) in enumerate(zip(sets, marks))], "node long, n long, signature binary, grams binary").repartition(3)
    parts = neardedup.band_keys(nodes).withColumn("root", F.col("node") % 50)
    got = [(min(r), max(r)) for r in neardedup.open_pairs(parts, nodes, neardedup.wide_bits(nodes.select("node", "grams", "signature")), 75).collect()]
    bits, bands = signatures(sets, neardedup.WIDE) & 1, marks.view("uint64")
    shared = {(a, b): int((bands[a] == bands[b]).sum()) for a in range(60) for b in range(a + 1, 60)
              if a % 50 != b % 50 and (bits[a] != bits[b]).sum() <= neardedup.WIDE_APART and 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b]))}
    assert sorted(got) == sorted(p for p, n in shared.items() if n) and max(shared.values()) > 1


def test_shingle_sets_without_texts_in_a_shuffle(spark, tmp_path, monkeypatch):
    """Sets are made where texts are read: what is joined and written holds no text, and only the wanted rows are in it."""
    rows = [(i if i % 9 else None, f"one two three four five six {i // 2}") for i in range(60)] + [(3, "one two three four five six 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = docs.where("doc_id is null or doc_id % 5 = 0").select(F.monotonically_increasing_id().alias("node"), "doc_id", F.xxhash64("text").alias("thash"))
    seen, plain = [], neardedup.settle
    monkeypatch.setattr(neardedup, "settle", lambda df, stem="llm": (seen.append(df), plain(df, stem))[1])
    got = {r.node: r.grams for r in neardedup.shingle_sets(docs, neardedup.settle(wanted), "doc_id", "text").collect()}
    assert len(got) == wanted.count() and set(got.values()) <= {shingles(t, WordHashes()).tobytes() for _, t in rows}
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan[: plan.index("MapInPandas")] and "MapInPandas" in plan[plan.index("Join"):]


def test_pipeline_stages_keep_arrow_batches_small(spark):
    """Executors keep their Python workers from stage to stage; a batch of any stage is bounded by bytes, not by Spark's 64 MB."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a text of its own"), (2, "another text " * 1500), (3, None)], "doc_id long, text string")
    for step, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.set(name, "64m")
        stage(spark, docs, "").count()
        assert spark.conf.get(name) == "8m", step
    spark.conf.set(name, before)
