"""Toxicity, language-model scoring and HTML extraction against plain versions and held-out rows; the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import htmltext, suffixtree, toxicity
from colscope.llm.queries import QUERIES


def test_segments_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        places = np.flatnonzero(rng.random(n) < 0.4).tolist()
        hits = [(p, float(rng.integers(1, 4))) for p in places]
        scores = np.full(n, -1.0)
        for p, s in hits:
            scores[p] = s
        total = np.r_[0, np.cumsum(scores)]
        best = max((total[j] - total[i] for i in range(n) for j in range(i + 1, n + 1)), default=0)
        got = toxicity.maximal_segments(hits, -1.0)
        assert max((s for *_, s in got), default=min(best, 0)) == max(best, min(best, 0)) or not hits
        assert all(s == total[b + 1] - total[a] for a, b, s in got)
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


@pytest.fixture(scope="module")
def toxic(spark, words):
    insults = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(500):
        w = words(20 + i % 60, 1000 + i).split()
        bad = i % 5 == 1
        if bad:
            for k in range(3):
                w.insert((7 * k + i) % len(w), insults[(i + k) % 3])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, "x"), (501, "", "x")]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity(spark, toxic, nothing):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    assert set(model.scores) == {"idiot", "moron", "scum"}
    got = toxicity.with_score(docs, model, score_col="p").collect()
    assert all((r.p >= 0.5) == (r.doc_id is not None and r.doc_id < 500 and r.doc_id % 5 == 1) and 0 <= r.p <= 1 for r in got)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(docs, model).count() == 402
    spans = toxicity.passages(docs, model).collect()
    assert {r.doc_id % 5 for r in spans} == {1}
    with pytest.raises(ValueError):
        toxicity.with_score(docs, model)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.with_score(nothing, none).count() == 0


def test_toxicity_labels_are_held_out(spark, toxic):
    docs, labels = toxic
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_inflected_insults_back_off_to_their_stem(spark, words):
    """Each form stands in at most three documents; a common word that begins like a listed one stays clean."""
    import itertools
    import random

    rng = random.Random(11)
    forms = ["".join(p) for p in itertools.product("aeiou", "lmnrst", "aeiou")]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = words(120, 1000 + i).split()
        if toxic:
            for k in range(4):
                text.insert(20 + 3 * k, "grumbo" + forms[(i // 6 * 4 + k) % len(forms)] + forms[(i + 7 * k) % len(forms)])
        elif i % 3 == 1:
            text.insert(50, "grum")
            text.insert(60, "grum")
        elif rng.random() < 0.05:
            text.insert(30, "grumbo" + forms[i % len(forms)])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.p for r in toxicity.with_score(docs, model, score_col="p").collect()}
    assert min(sum(w.startswith("grumbo") for w in t.split()) for i, t in rows if i % 6 == 0) == 4
    held = [i for i, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    caught = [got[i] >= 0.5 for i in held if i % 6 == 0]
    false = [got[i] >= 0.5 for i in held if i % 6]
    assert sum(caught) >= 0.95 * len(caught) and sum(false) <= 0.02 * len(false)
    assert "grum" not in model.scores and model.score("grum") == 0 < model.score("grumbozzz")


def test_toxicity_of_words_that_no_clean_document_has(spark, words):
    """Rare next to all documents, but in toxic ones alone: the clearest words there are."""
    insults = [f"{a}zzat" for a in "klmnpqrs"]
    rows = [(0, words(12, i)) for i in range(3000)] + [(1, words(12, -1 - i) + " " + insults[i % 8]) for i in range(64)]
    scores, *_ = toxicity.word_scores(spark.createDataFrame(rows, "toxic int, text string").repartition(4))
    assert set(insults) <= set(scores) and all(w.rstrip("*") in {i[:k] for i in insults for k in range(3, 9)} for w in scores)
    # many of both: as by standard errors; none among the clean: the deviance of the total alone; too few
    got = toxicity.least_odds(np.array([400.0, 1e-9, 1e-9]), np.array([300.0, 30.0, 3.0]), 36000.0, 4000.0, 4.0)
    assert got[0] == pytest.approx(math.log(300 / 3700) - math.log(400 / 35600) - 4 * math.sqrt(1 / 400 + 1 / 300), abs=0.05)
    assert got[1] == pytest.approx(math.log(9) - math.log(math.exp(16 / 60) - 1), abs=0.05) and got[2] == 0


def test_toxicity_of_a_very_long_and_of_repeated_texts(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    long = "so it goes on and on " * 100_000
    rows = [(1, long), (2, long + " you idiot moron scum idiot moron"), (3, "you idiot moron scum"), (3, "you idiot moron scum"), (4, None)]
    got = toxicity.with_score(spark.createDataFrame(rows, "doc_id long, text string"), model, score_col="p").collect()
    p = [r.p for r in sorted(got, key=lambda r: r.doc_id)]
    assert p[0] < 0.5 and p[2] == p[3] and all(0 <= x <= 1 for x in p) and p[1] > p[0]


def test_scores(spark, folder):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    seen = Counter(w for i, t in rows.items() if not held[i] for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in QUERIES["op8_score"](spark, folder).collect()}
    assert sorted(got) == sorted(rows)
    for i, t in rows.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens(t)), sum(w in seen for w in tokens(t)), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_tree_is_a_distribution(spark, words):
    df = spark.createDataFrame([(i, ("new york " if i % 2 else "big apple ") + words(30, i)) for i in range(200)], "doc_id long, text string")
    tree, counts = suffixtree.fit(df)
    assert tree.levels and any(level.kept.any() for level in tree.levels)
    everything = np.arange(len(tree.head))
    rare = tree.tokens + tree.words + 1 - int((tree.head_counts + 1).sum())  # weight of rare words and the unknown class
    root = sum(10 ** tree.root_log)
    assert root + rare / (tree.tokens + tree.words + 1) == pytest.approx(1)
    for depth, level in enumerate(tree.levels, 1):
        for context in range(min(20, len(level.contexts))):
            p = sum(10 ** suffixtree.log_next(tree, depth, np.full(len(everything), context), everything))
            back, d, at = 0.0, depth, context
            while d:
                back, at, d = back + tree.levels[d - 1].back[at], tree.levels[d - 1].suffix[at], d - 1
            assert p + 10**back * rare / (tree.tokens + tree.words + 1) == pytest.approx(1, abs=1e-6)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "never seen words"), (2, "never seen words")], "doc_id long, text string")
    rows = suffixtree.score(odd, tree, counts).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 4, 4] and all(r.score < 0 for r in rows)
    empty, none = suffixtree.fit(df.where("false"))
    assert suffixtree.score(odd, empty, none).count() == 4 and suffixtree.score(odd.where("false"), empty, none).count() == 0


def test_tree_grows_with_the_input(spark, words):
    """Contexts and next words count from a fixed number of occurrences on, and as far back as they tell something."""
    rows = [(i, words(30, i)) for i in range(2500)] + [(3000 + i, "rareone raretwo") for i in range(4)]
    tree, counts = suffixtree.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert tree.tokens * 1e-4 > 4  # too few for a share of all tokens
    asked = spark.createDataFrame([(1, "rareone raretwo"), (2, "raretwo rareone")], "doc_id long, text string")
    got = {r.doc_id: r.score - r.base_score for r in suffixtree.score(asked, tree, counts).collect()}
    assert got[1] > 3 > 1 > got[2]
    # the word after "x y z" is decided three words before
    far = [(i, ("a x y z b " if i % 2 else "c x y z d ") + words(5, i)) for i in range(400)]
    tree, counts = suffixtree.fit(spark.createDataFrame(far, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a x y z b"), (2, "a x y z d")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffixtree.score(asked, tree, counts).collect()}
    assert len(tree.levels) >= 4 and got[1] > got[2] + 1


def test_scores_against_the_tree(spark, words, monkeypatch):
    """Scores by joined terms are those of a walk through the tree, whichever sequences are sent to all tasks."""
    rows = [(i, ("new york " if i % 2 else "big apple ") + words(20, i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = None
    for share in (2e-6, 1.0):
        monkeypatch.setattr(suffixtree, "HOT_SHARE", share)
        tree, counts = suffixtree.fit(df)
        got = {r.doc_id: (r.n_known, r.base_score, r.score) for r in suffixtree.score(df, tree, counts).collect()}
        if want is None:
            known = suffixtree.WordHashes()
            want = {}
            for i, t in rows[:40]:
                word, doc = suffixtree.tokens_of([t], known)
                total = 0.0
                for k in range(len(word)):
                    context, depth = 0, 0
                    for d, level in enumerate(tree.levels, 1):
                        if k < d:
                            break
                        key = list(suffixtree.sequences_of(word[:k], doc[:k], d))[-1][0][-1:]
                        at = int(suffixtree.find(level.contexts, key)[0])
                        if at >= 0 and level.kept[at]:
                            context, depth = at, d
                    total += float(suffixtree.log_next(tree, depth, np.array([context]), suffixtree.find(tree.head, word[k: k + 1]))[0])
                want[i] = total
            first = got
        assert got == {i: (n, pytest.approx(b), pytest.approx(s)) for i, (n, b, s) in first.items()}
        assert {i: got[i][2] for i in want} == pytest.approx(want)


def test_tokens_hashed_side_by_side():
    """Equal words have equal hashes, others not, of any length and beside any white space; words over LONG bytes alone are looked up."""
    odd = ["", None, "  a B\tc\x0bd\x0c ", "Straße ŒUVRE x A b", "y" * 63 + " " + "Y" * 64 + " " + "z" * 65 + " " + "z" * 200, "abcdefgh abcdefghi\r\nabcdefg \0 \0\0", "\xa0 \x85 \x1c ab", " ", "ab"]
    plain = [[*(t or "").encode().lower().split(), b""] for t in odd]
    known = suffixtree.WordHashes()
    hashes, text = suffixtree.tokens_of(odd, known)
    assert text.tolist() == [i for i, words in enumerate(plain) for _ in words] and set(known) == {b"", b"z" * 65, b"z" * 200}
    pairs = set(zip((w for words in plain for w in words), hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert [len(x) for x in suffixtree.tokens_of([], known)] == [0, 0]


def plain_tree(texts):
    """For each length the kept contexts (as tuples of words) of a tree that counts every sequence, without pruning."""
    docs = [[*t.lower().split(), ""] for t in texts]
    count = lambda k: Counter(tuple(d[i: i + k]) for d in docs for i in range(len(d) - k + 1))
    words = count(1)
    tokens = sum(words.values())
    shorter = {w: (n, (n + 1) / (tokens + len(words) + 1)) for w, n in words.items() if n >= 3}
    found = []
    while True:
        following = {}
        for q, n in count(len(found) + 2).items():
            if n >= 3:
                following.setdefault(q[:-1], []).append((q, n))
        kept, longer = set(), {}
        for s, some in following.items():
            held, t = shorter[s][0], len(some)
            less = [shorter[q[1:]][1] for q, _ in some]
            prob = [(n + t * b) / (held + t) for (_, n), b in zip(some, less)]
            longer |= {q: (n, p) for (q, n), p in zip(some, prob)}
            left = max(1e-12, 1 - sum(prob)) / max(1e-12, 1 - sum(less))
            gain = sum(n * math.log(p / b) for (_, n), p, b in zip(some, prob, less)) + (held - sum(n for _, n in some)) * math.log(left)
            if gain > t * math.log(held) / 2:
                kept.add(s)
        if not kept:
            break
        found.append(kept)
        shorter = longer
    for below, above in reversed(list(zip(found, found[1:]))):
        below |= {s[1:] for s in above}
    return found


def copied_texts():
    """Families of texts whose last words are decided 1 to 30 words before, and long copies, among other texts."""
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [some(30) for _ in range(40)]
    for far in range(1, 31):
        passage = some(far)
        texts += [f"{some(2)} {'left' if i % 2 else 'right'} {passage} {'up' if i % 2 else 'down'} {some(3)}" for i in range(8)]
    return texts + [some(50)] * 3


def test_tree_against_all_counts(spark):
    """Long contexts are grown from windows, and closed ones aren't grown: the tree is that of all counts, its terms those of its walk."""
    texts = copied_texts()
    want = plain_tree(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = "colscope-tree"
    spark.sparkContext.setJobGroup(group, group)
    tree, counts = suffixtree.fit(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tree.depth == len(want) >= 30 and jobs < 5 * tree.depth  # lengths share their jobs
    known = suffixtree.WordHashes()

    def key(s):
        word, doc = suffixtree.tokens_of([" ".join(s)], known)
        return int(list(suffixtree.sequences_of(word[:-1], doc[:-1], len(s)))[-1][0][-1])

    assert [set(level.contexts[level.kept].tolist()) for level in tree.levels] == [{key(s) for s in some} for some in want]
    got = {r.doc_id: r.score for r in suffixtree.score(df, tree, counts).collect()}
    for i in range(40, len(texts), 41):
        word, doc = suffixtree.tokens_of([texts[i]], known)
        total = 0.0
        for k in range(len(word)):
            context, depth = 0, 0
            for d, level in enumerate(tree.levels, 1):
                if k < d:
                    break
                at = int(suffixtree.find(level.contexts, list(suffixtree.sequences_of(word[:k], doc[:k], d))[-1][0][-1:])[0])
                if at >= 0 and level.kept[at]:
                    context, depth = at, d
            place = suffixtree.find(tree.head, word[k: k + 1])
            if place[0] < 0:  # a rare word: the root's probability times the share of every kept suffix
                p = math.log10(counts.where(f"word = {word[k]}").first()["n"] + 1) - tree.log_total
                while depth:
                    p, context, depth = p + tree.levels[depth - 1].back[context], int(tree.levels[depth - 1].suffix[context]), depth - 1
            else:
                p = float(suffixtree.log_next(tree, depth, np.array([context]), place)[0])
            total += p
        assert got[i] == pytest.approx(total)


def test_groups_are_bounded(spark, monkeypatch):
    """Windows of one very common context are grown in many tasks, contexts are marked in groups of a bounded size, and the tree stays the same."""
    rng = random.Random(4)
    texts = []
    for _ in range(600):
        a, b, c = (f"m{rng.randrange(12)}" for _ in range(3))
        texts.append(f"{a} {b} of the {a}{b} {c}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of, the = (suffixtree.tokens_of([t], suffixtree.WordHashes())[0][:1] for t in ("of", "the"))
    common, at = int(suffixtree.mixed(of, the)[0]), suffixtree.TEXT_PASSES
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a file for each task that has rows
    found = []
    try:
        for size, marked in ((suffixtree.GROUP_BYTES, suffixtree.MARKED), (1 << 10, 50)):
            monkeypatch.setattr(suffixtree, "GROUP_BYTES", size)
            monkeypatch.setattr(suffixtree, "MARKED", marked)
            tree, counts = suffixtree.fit(df)
            sequences, contexts = tree.tables[at]
            longer = contexts.where((F.col("depth") == at + 1) & (F.col("s") == common)).select(F.col("key").alias("p"))
            files = sequences.withColumn("file", F.input_file_name()).join(longer, "p").select("file").distinct().count()
            scores = sorted((r.doc_id, round(r.score, 6)) for r in suffixtree.score(df, tree, counts).collect())
            found.append((longer.count(), scores, [(x.contexts[x.kept].tolist(), x.next.tolist(), x.next_log.round(9).tolist()) for x in tree.levels], files))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    (contexts, *same, one), (*others, many) = found
    assert contexts >= 8 and others == [contexts, *same]
    assert one == 1 and many > 2


def test_scores_leave_only_what_they_read(spark, folder):
    """Tables of a length go when the next ones stand, and all of them before texts are scored."""
    from pathlib import Path

    from colscope.functions.session import shared_folder

    place = Path(shared_folder(spark).removeprefix("file:"))
    before = set(place.iterdir())
    scored = QUERIES["op8_score"](spark, folder)
    left = sorted(p.name.split("-")[0] for p in set(place.iterdir()) - before)
    assert left == ["terms", "words"] and scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


PAGES = [
    ("<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a href=/>home</a> <a href=/b>b</a></nav><div class=\"ad\">Buy now please.</div>"
     "<article><h1>A &amp; B</h1><p><b>First  part<br>of it.<p>Second\npart here, with &eacute;.</article><footer>&copy; us</footer></body></html>",
     "A & B First part of it. Second part here, with é."),
    ("<body><nav>menu</nav><article><p>Only this sentence stays in here.</p><p>cut o", "Only this sentence stays in here. cut o"),
    ("<article><p>Text with words and <form><input>search words</form> more words.</p><aside>Also read that</aside><div class='comments'><p>I disagree with all</p></div></article>",
     "Text with words and more words."),
    (None, ""), ("", ""), ("<p></p><!-- no words -->", ""), ("plain words without any tags", "plain words without any tags"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").repartition(3)
    weights = htmltext.learn(df)
    got = {r.page_id: r.text for r in htmltext.extract(df, weights).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert weights["word"] > 0 > weights["<"]
    assert htmltext.learn(df.where("false"))["word"] == 1.0
    with pytest.raises(ValueError):
        htmltext.extract(df, weights, text_col="url")


def test_html_layouts_adverts_and_captions(spark):
    lead, advert, rest = " ".join(f"lead{i}" for i in range(20)), "buy now " * 40, "the rest of it all"
    pages = {
        f"<div class='layout with-sidebar'><article><p>{lead}</p></article></div>": lead,
        f"<div class='layout page_sidebar'><article><p>{lead}</p></article><div class=site-footer>imprint</div></div>": lead,
        f"<nav>x y</nav><article><p>{lead}</p><div class=ad-slot><p>{advert}</p></div><p>{rest}</p><section class=comments><article>No!</article></section></article>": f"{lead} {rest}",
        f"<article><p>{lead}</p><figure><img src=a><figcaption>A caption.</figcaption></figure><svg><text>in a drawing</text></svg></article>": f"{lead} A caption. in a drawing",
        f"<article><p title=\"a > b\" class='x'>{lead}</p><p title=\"cut\"\">{rest}</p></article>": f"{lead} {rest}",
        f"<div class='page_sidebar'><div><p>{lead}</p></div></div><div class='sidebar'>menu of it</div>": lead,
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*pages, *pages])], "page_id long, html string")
    weights = htmltext.learn(df)
    got = {r.page_id: r.text for r in htmltext.extract(df, weights).collect()}
    assert got == dict(enumerate([*pages.values()] * 2))
    assert {"page_sidebar", "with-sidebar"} <= htmltext.layout_of(weights)


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "</p></i>" * 20_000 + "text", "<b>" * 20_000 + "<div></div>" * 20_000 + "text", "<b><div>" * 20_000 + "text",
    "<p><object>" + "<b>" * 20_000 + "<div></div>" * 20_000 + "text", "<a " * 40_000 + "'", "<a ='x\" " * 20_000 + "<b =\"", "<!-" * 40_000 + "text",
    "<article><div class=ad>" + "<b>word " * 20_000])
def test_html_time_is_linear(page):
    import time

    begin = time.process_time()
    htmltext.main_text(page, {"word": 1.0, "link": 0.5, "aside": -1.0, "<": -0.05})
    assert time.process_time() - begin < 3


def test_html_run_against_all_runs():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randint(-4, 4) for _ in range(rng.randrange(12))]
        runs = [(sum(x[a:b]), -b, a) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
        most = max(runs, default=(0, 0, 0))[0]
        first, last = htmltext.best_run(x)
        assert sum(x[first:last]) == max(0, most)
        if most > 0:
            assert last == min(-b for total, b, _ in runs if total == most)


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = [], [docs]
    for name, stage in corpus_pipeline.STAGES:
        from colscope.llm.common import settle

        names.append(name)
        kept.append(settle(stage(spark, kept[-1], folder)))
        if name != "packing":
            assert kept[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in k.select("doc_id").distinct().collect()) for k in kept]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    assert all(set(a) >= set(b) for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
    texts = lambda k: {r.doc_id: r.text for r in k.collect()}
    first = {}
    for i, t in sorted(texts(kept[1]).items()):
        first.setdefault(" ".join(__import__("re").split("[\x20\x09-\x0d]+", t)), i)
    assert ids[2] == sorted(first.values())
    from tests.llm.test_copies import plain_components, plain_removals

    assert ids[3] == sorted({c for _, _, c in plain_components(list(texts(kept[2]).items()))})
    removed = {i: n for i, n, *_ in [(r[0], r[1] - r[2]) for r in plain_removals(sorted(texts(kept[3]).items()))]}
    for i, t in texts(kept[4]).items():
        assert 0 <= removed[i] - len(t.encode()) <= 6
