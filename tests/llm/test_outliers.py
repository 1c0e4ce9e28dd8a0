"""Quality rules: counts against plain loops, the estimate against a plain one, planted junk."""

import math
import random
import re

import numpy as np
import pytest

from colscope.llm import outliers as O


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for w in words)


def texts():
    rng = random.Random(4)
    rows = []
    for i in range(420):
        text = prose(i, rng.randint(60, 200))
        if i % 40 == 7:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 40 == 17:
            text = " | ".join(text.split())
        if i % 40 == 27:
            text = " ".join("a " + w for w in text.split()).upper()
        rows.append((i, text, "en" if i % 4 else "fr", None if i % 9 == 0 else f"s{i % 2}"))
    return rows


def test_counts(odd_rows):
    samples = [t for _, t, *_ in odd_rows if not t or len(t) < 3000] + ["a a a a", "x y z x y z q x y z", "a\n\na\nb\r\nb\r\n", "#*$%&|<> | |", "\x1c \x85x\xa0y"]
    for t in samples:
        assert O.text_counts(t)[:5] == plain_counts(t), t


def test_chi_square():
    assert abs(O.chi_square(0.5) - 5.348) < 1e-3 and abs(O.chi_square(0.975) - 14.449) < 1e-3


def plain_estimate(x):
    """The same rules on one group in plain numpy: x whole numbers (rows x P)."""
    x = np.unique(x, axis=0).astype(float)
    floor = np.diag([(s * O.UNIT) ** 2 for s in O.SPREAD])

    def moments(rows):
        return rows.mean(0), np.cov(rows.T, bias=True) + floor

    def d2(mean, cov):
        d = x - mean
        return np.maximum((d @ np.linalg.inv(cov) * d).sum(1), 0)

    def bins(d):
        return np.floor(np.log2(d + 2.0 ** -10) * O.FINE).astype(int)

    q = [np.quantile(x, p, axis=0, method="inverted_cdf") for p in (0.25, 0.5, 0.75)]
    found = []
    for mean, cov in (moments(x), (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor)):
        for _ in range(O.STEPS):
            b = bins(d2(mean, cov))
            cut = np.sort(b)[math.ceil(O.HALF * len(x)) - 1]
            mean, cov = moments(x[b <= cut])
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    b = bins(d2(mean, cov))
    middle = np.sort(b)[math.ceil(0.5 * len(x)) - 1]
    factor = max(1.0, 2.0 ** ((middle + 1) / O.FINE) / O.chi_square(0.5))
    mean, cov = moments(x[2.0 ** (b / O.FINE) <= factor * O.chi_square(O.WITHIN)])
    return mean, np.linalg.inv(cov)


def test_estimate_against_plain(spark):
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(0, 1, (800, O.P)) @ rng.normal(0, 200, (O.P, O.P)) + 1000).astype(int)
    x[:150] += 9000
    x[200:230] = x[200]
    rows = [("g", "s", *map(int, r)) for r in x] + [("h", "s", *map(int, r)) for r in x[::2] * 2]
    df = spark.createDataFrame(rows, "group_lang string, group_source string, " + ", ".join(f"{d} long" for d in O.DIMS)).repartition(4)
    got = {r["group_lang"]: r for r in O.fit(df, steps=O.STEPS).collect()}
    for name, sample in (("g", x), ("h", x[::2] * 2)):
        mean, inverse = plain_estimate(sample)
        assert np.allclose([got[name][c] for c in O.CENTER], mean, rtol=1e-6)
        assert np.allclose([got[name][q] for q in O.PRECISION], [inverse[i, j] for i, j in O.CROSS], rtol=1e-5, atol=1e-12)
    assert abs(got["g"]["c0"] - x[150:, 0].mean()) < 60  # the shifted rows don't move the centre


def test_junk_goes_and_prose_stays(spark, tmp_path):
    rows = texts() + [(900, None, "en", "s1"), (901, "", None, None), (902, prose(1, 40), "en", "s1"), (903, "spam egg " * 200, "en", "s0"),
                      (904, prose(7, 30000), "en", "s0"), (5, texts()[5][1], "en", "s1")]
    spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, source string, x0 int, counts string").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = O.op11_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] != 904:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(text[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        junk = r["base_failed"] or r["doc_id"] < 420 and r["doc_id"] % 40 in (7, 17, 27)
        assert r["kept"] == (not junk), r


def test_rows_keep_their_columns(spark, odd, nothing):
    kept = O.reject_outliers(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in odd.where("length(text) > 150").collect()}
    assert O.reject_outliers(nothing).collect() == []
    with pytest.raises(ValueError):
        O.with_counts(odd, into="doc")
