"""Toxic passages as maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Weights. For each word, and each word-initial piece of 3 to 8 letters, the log-odds of standing in a toxic rather than a clean
document, with a Dirichlet prior that follows its overall frequency; documents, not occurrences, are counted, and of a group of near
copies one counts, so that neither long nor copied documents make a word look toxic. A word or piece is listed when the lower
end of its log-odds' likelihood interval is clearly positive, and that lower bound is its score; the interval holds also where no
clean document has the word, which is the clearest case and the one in which standard errors grow without limit. A word of many documents
scores for itself; a rarer one as the strongest of itself and its pieces, which are counted over rare words only: inflected forms that
are each too rare back off to what they share. Any other word scores the (negative)
log ratio of not being listed.

Passages. A linear scan finds every maximal scoring segment (all that can't be extended, shortened or joined for
a higher sum); words between two listed ones are one run of equal negative scores.

Calibration. The best of many segments in clean text follows an extreme-value law: at least s with the
probability 1 - exp(-K n exp(-lambda s)) in n words. lambda solves E[exp(lambda score)] = 1 over clean
training words, K fits their best segments. Each passage's evidence is lambda s - ln(K n); a document's is that of its passages' sum
(several weak passages together are as telling as a strong one), and a logistic curve, fitted
on training documents that gave no weights, makes it a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents, filled, free_name, remainder, settle, whole_text

WORD = re.compile(r"\w+")
#: Training documents, about; the labelled rows are sampled down to it by a hash of doc_id.
TRAIN_ROWS = 40_000
#: One in so many training documents calibrates; the others give the weights.
CALIBRATE = 4
#: Weight of the Dirichlet prior, toxic documents that a listed word needs, and words listed by chance (over all words
#: that are tested), from which the width of the intervals follows.
PRIOR, LEAST, BY_CHANCE = 20.0, 4, 0.5
#: Lower bound of the log-odds from which on a word is listed: weaker words say what a text is about, not that it is toxic.
LEAST_ODDS = 0.7
#: Documents from which on a word has its own odds, listed or not, instead of its pieces'.
KNOWN = 30
#: Lengths of the word-initial pieces; PIECE marks one, as no word holds that sign.
PIECES, PIECE = range(3, 9), "*"
#: Words whose scores a worker remembers.
REMEMBERED = 100_000
#: Odd multipliers of the orders in which near copies are looked for.
ORDERS = [0x9E3779B97F4A7C15 * k % (1 << 63) for k in range(1, 9)]
#: A passage is significant from this evidence on: by chance one in e**3 documents has such a passage.
SIGNIFICANT = 3.0


@dataclass
class Model:
    """Scores of listed words and pieces, that of any other word, the words judged by themselves alone, the extreme-value law and the logistic curve."""

    scores: dict[str, float]
    other: float
    own: frozenset = frozenset()
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def score(self, word: str) -> float:
        """The strongest of the word and, unless it has its own odds, its pieces; 0 where none is listed."""
        known = self.__dict__.setdefault("_known", {})
        if word not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = self.scores.get(word, 0.0) if word in self.own else max((self.scores.get(f, 0.0) for f in features_of(word)), default=0.0)
        return known[word]

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Place and score of the listed words."""
        return [(i, s) for i, s in enumerate(map(self.score, words)) if s > 0]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.shift))))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in order.

    hits: place and (positive) score of the listed words; each other place scores `other` (negative). One pass:
    a stack of candidates with the sums before and after each; a new one is joined with the last candidate
    that begins lower, as long as that candidate ends lower than the new one.
    """
    stack: list[list] = []
    total, last = 0.0, -1
    for place, score in hits:
        total += other * (place - last - 1)
        new = [place, place, total, total + score]
        total += score
        last = place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after in stack]


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + PIECE for k in PIECES if len(word) >= k)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def found(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    """Maximal segments of a document's words."""
    return maximal_segments(model.hits(words), model.other)


def chance_of(words: list[str], model: Model) -> float:
    """ln(K n), at least 0: few words are no evidence."""
    return max(0.0, math.log(model.k * max(1, len(words))))


def evidence(words: list[str], model: Model) -> float:
    """Evidence of all passages together; without any, that of a segment of score 0.

    The r best segments of clean text add up to x with the probability exp(-x) x^(r-1) / (r! (r-1)!); the least likely of all r counts.
    """
    chance = chance_of(words, model)
    each = sorted((model.lam * s - chance for *_, s in found(words, model)), reverse=True)
    best, x = each[0] if each else -chance, 0.0
    for r, own in enumerate(each, 1):
        if own <= 0:
            break
        x += own
        # for sums below r - 1 the law does not hold
        if x >= r - 1:
            best = max(best, x - (r - 1) * math.log(x) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def copy_keys(words: list[str]) -> list[int]:
    """For each of the ORDERS the smallest of the hashes of five words in a row: near copies agree in most of them."""
    step = max(1, min(5, len(words)))
    hashes = np.array([hash_of(" ".join(words[i: i + step])) for i in range(max(1, len(words) - step + 1))], np.uint64)
    return [int((hashes * np.uint64(2 * k + 1) ^ (hashes >> np.uint64(31)) * np.uint64(k)).min() >> np.uint64(1)) for k in ORDERS]


def hash_of(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, text of the training documents: about `rows` labelled ones, whose remainder mod 5 isn't 0, one of each group of near copies."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").where(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    # bounded by `rows`, so it is sent to all tasks and no text is moved
    texts = slim.join(F.broadcast(known), "doc_id")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            found = [copy_keys(words_of(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "keys": found})

    # a row per document and order; a document goes if an earlier one has its key in half of the orders
    listed = settle(texts.mapInPandas(keys, "doc_id long, keys array<long>").select("doc_id", F.posexplode("keys").alias("turn", "key")), "keys")
    first = listed.groupBy("turn", "key").agg(F.min("doc_id").alias("first"))
    copies = listed.join(first, ["turn", "key"]).where("doc_id > first").groupBy("doc_id").count().where(
        F.col("count") >= len(ORDERS) // 2).select("doc_id")
    return settle(texts.join(F.broadcast(copies), "doc_id", "left_anti"), "training")


def word_scores(training: DataFrame) -> tuple[dict[str, float], frozenset, int, int]:
    """(scores of the listed words and pieces, words judged by themselves alone, clean and toxic documents).

    A word that stands in KNOWN documents has its own odds and takes no part in any piece's: pieces speak for rare words only. Of the
    rest only what stands in LEAST toxic documents is tested, so clean documents are counted for those alone. All lists are
    bounded by TRAIN_ROWS.
    """
    def counts(own: frozenset | None, wanted: frozenset | None = None):
        """Documents per word (own is None), or per feature of the words outside own, as far as wanted."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for text in b["text"]:
                    words = set(words_of(text))
                    found = words if own is None else {f for w in words - own for f in features_of(w)}
                    seen.update(found if wanted is None else found & wanted)
            yield pd.DataFrame({"feature": list(seen), "n": list(seen.values())}, columns=["feature", "n"]).astype({"feature": object, "n": "int64"})
        return run

    def table(toxic: int, *args) -> DataFrame:
        return training.where(F.col("toxic") == toxic).mapInPandas(counts(*args), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return {}, frozenset(), n0, n1
    both = table(0, None).withColumnRenamed("n", "clean").join(table(1, None).withColumnRenamed("n", "toxic"), "feature", "full").fillna(0)
    tested = {r["feature"]: (r["clean"], r["toxic"]) for r in both.where(F.col("clean") + F.col("toxic") >= KNOWN).collect()}
    own = frozenset(tested)
    toxic = {r["feature"]: r["n"] for r in table(1, own).where(F.col("n") >= LEAST).collect()}
    clean = {r["feature"]: r["n"] for r in table(0, own, frozenset(toxic)).collect()}
    tested |= {f: (clean.get(f, 0), c1) for f, c1 in toxic.items()}
    z = NormalDist().inv_cdf(1 - BY_CHANCE / max(2, len(tested)))
    tested = {f: (c0, c1) for f, (c0, c1) in tested.items() if c0 + c1 < n0 + n1 and c1 >= LEAST}
    if not tested:
        return {}, own, n0, n1
    c0, c1 = np.array(list(tested.values()), float).T
    prior = PRIOR * (c0 + c1) / (n0 + n1)
    bound = least_odds(c0 + prior, c1 + prior, n0 + PRIOR, n1 + PRIOR, z)
    return {f: b for f, b in zip(tested, bound.tolist()) if b > LEAST_ODDS}, own, n0, n1


def least_odds(c0: np.ndarray, c1: np.ndarray, n0: float, n1: float, z: float) -> np.ndarray:
    """Lower ends of the likelihood intervals (z wide) of the log-odds ratios of c1 in n1 against c0 in n0; 0 where that isn't positive.

    For a ratio r the likeliest share p of n0 solves n1 r p / (1 + (r - 1) p) + n0 p = c0 + c1; the ratio is too low while the
    deviance from the observed shares is over z * z.
    """
    def too_low(odds: np.ndarray) -> np.ndarray:
        r = np.exp(odds)
        a, b = n0 * (r - 1), n1 * r + n0 - (c0 + c1) * (r - 1)
        p = 2 * (c0 + c1) / (b + np.sqrt(b * b + 4 * a * (c0 + c1)))
        q = r * p / (1 + (r - 1) * p)
        deviance = 2 * sum(x * np.log(x / y) for x, y in ((c0, n0 * p), (n0 - c0, n0 * (1 - p)), (c1, n1 * q), (n1 - c1, n1 * (1 - q))))
        return deviance > z * z

    high = np.maximum(0.0, np.log(c1 / (n1 - c1)) - np.log(c0 / (n0 - c0)))
    low = np.zeros(len(high))
    for _ in range(50):
        mid = (low + high) / 2
        far = too_low(mid)
        low, high = np.where(far, mid, low), np.where(far, high, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from labelled training documents: calibrated on a part that gave no weights, then with the weights of all.

    Without any documents of one class every document scores the share of toxic ones.
    """
    training = training_rows(docs, labels, rows)
    calibrates = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(CALIBRATE)) == 0
    everything, all_own, n0, n1 = word_scores(training)
    scores, own = word_scores(training.where(~calibrates))[:2]
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1.0) if n0 + n1 else 0.0
        return Model({}, -1.0, slope=0.0, shift=math.log(share / (1 - share)) if share else -30.0)

    def profile(model: Model | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in filled(batches):
                words = [words_of(t) for t in b["text"]]
                hits = [[s for _, s in (model or Model(scores, -1.0, own)).hits(ws)] for ws in words]
                yield pd.DataFrame({"toxic": b["toxic"], "words": [len(w) for w in words], "hits": [len(h) for h in hits],
                                    "best": [0.0 if model is None else max((s for *_, s in found(w, model)), default=0.0) for w in words],
                                    "listed": hits, "evidence": [0.0 if model is None else evidence(w, model) for w in words]})
        return run

    shape = "toxic int, words long, hits long, best double, listed array<double>, evidence double"
    held = training.where(calibrates)
    seen = held.mapInPandas(profile(None), shape).toPandas()
    rate = [(seen.loc[seen.toxic == y, "hits"].sum() + 0.5) / (seen.loc[seen.toxic == y, "words"].sum() + 1.0) for y in (0, 1)]
    rate[1] = max(rate[1], 2 * rate[0])
    model = Model(scores, min(-1e-4, math.log(max(1e-9, 1 - rate[1]) / (1 - min(rate[0], 0.5)))), own)
    clean = seen[seen.toxic == 0]
    model.lam = positive_root(Counter(x for row in clean["listed"] for x in row), int(clean["words"].sum()), model.other)
    # K from the clean documents' best segments: the mean of n exp(-lambda s) is about 1 / K
    seen = held.mapInPandas(profile(model), shape).toPandas()
    clean = seen[(seen.toxic == 0) & (seen.words > 0)]
    if len(clean):
        model.k = min(1.0, max(1e-6, float(1 / (clean.words * np.exp(-model.lam * clean.best)).mean())))
    seen = held.mapInPandas(profile(model), shape).toPandas()
    model.slope, model.shift = logistic(seen["evidence"].to_numpy(float), seen["toxic"].to_numpy(float))
    model.scores, model.own = everything, all_own
    model.__dict__.pop("_known", None)
    return model


def positive_root(hits: Counter, words: int, other: float) -> float:
    """The lambda > 0 at which the mean of exp(lambda score) over clean words is 1; 1 where no clean word is listed."""
    total = sum(hits.values())
    if not total or total >= words:
        return 1.0
    f = lambda x: sum(n * math.exp(x * s) for s, n in hits.items()) + (words - total) * math.exp(x * other) - words
    low, high = 0.0, 0.01
    while f(high) < 0 and high < 20:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return min(max(high, 0.05), 5.0)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the likeliest logistic curve, with a light pull to 0."""
    if not len(x):
        return 0.0, -30.0
    scale = max(1.0, float(np.abs(x).max()) / 20)
    x = np.clip(x, -20 * scale, 20 * scale) / scale
    w = np.zeros(2)
    design = np.column_stack((x, np.ones(len(x))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])) / scale, float(w[1])


def passages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first and last character (from 0), score and evidence of every significant passage of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].astype("Int64").array, b["text"]):
                low = text.lower() if text else ""
                at = [m.span() for m in WORD.finditer(low)]
                words = [low[a:z] for a, z in at]
                chance = chance_of(words, model)
                for i, j, s in found(words, model):
                    if model.lam * s - chance >= SIGNIFICANT:
                        out.append((doc, at[i][0], at[j][1] - 1, s, model.lam * s - chance))
            yield pd.DataFrame(out, columns=["doc_id", "first", "last", "score", "evidence"]).astype({"doc_id": "Int64"})

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return slim.mapInPandas(run, "doc_id long, first long, last long, score double, evidence double")


def with_score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the toxicity of each row's whole text, 0 to 1; null and empty texts score as texts without passages."""
    if score_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {score_col}")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.probability(evidence(words_of(t), model)) for t in texts], dtype="float64")

    return df.withColumn(score_col, score(whole_text(text_col)))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that score under the threshold, with their columns."""
    name = free_name(df, "toxicity")
    return with_score(df, model, text_col, name).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, documents(spark, folder, "labels"))
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
