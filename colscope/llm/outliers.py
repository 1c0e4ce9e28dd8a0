"""Quality rules: documents whose statistics are multivariate outliers of their language and source.

Counts. Words are `[^\\x20\\x09-\\x0D]+`; from them, the lines and the signs of the whole text follow six transformed
statistics: logarithm of the mean word length, and square roots of five shares (symbols per word, repeated words,
duplicate lines, upper-case words, words with a sign). They are kept as whole numbers (1/1024), so that every sum below is
exact and no verdict hangs on the order of rows.

Estimate. Per language and source the minimum covariance determinant: of all its rows the 75 % with the smallest
Mahalanobis distances give the next mean and covariance, until the determinant no longer falls, from two fixed starts
(medians with quartile ranges, and plain moments), of which the smaller determinant wins. A step is one aggregation: sums
per group and narrow distance bin, so the cut at 75 % is found among the bins and no group is ever sorted or gathered.
Equal vectors count once, lest one much-copied text be taken for the usual. The estimate is rescaled by the median
distance and made once more from the rows within its 97.5 % ellipsoid.

Verdict. A row is rejected when its squared distance exceeds the chi-square quantile of `LEVEL`. SPREAD is the least
deviation that counts in each statistic: most shares are 0 in most texts, and the covariance would be singular.

Groups under `LEAST` rows are pooled by language, and what is still under LEAST over all languages; if even that pool is
too small, it is judged by an estimate of all rows. Null languages and sources are groups of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import documents, free_name, settle, whole_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_signed_words")
COUNT_DDL = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
#: Statistics are whole multiples of 1 / UNIT; SPREAD is the least standard deviation of each that counts.
UNIT = 1024
SPREAD = (0.06, 0.06, 0.15, 0.20, 0.06, 0.05)
P = len(SPREAD)
#: Share of a group's rows that the estimate is made of, rows that make a group, steps at most.
HALF, LEAST, STEPS = 0.75, 100, 12
#: Quantiles of the chi-square law: of the rows in the last estimate, and of the rows that stay.
WITHIN, LEVEL = 0.975, 1 - 1e-6
#: Distance bins per doubling of the squared distance.
FINE = 32
DIMS = [f"x{i}" for i in range(P)]
CROSS = [(i, j) for i in range(P) for j in range(i, P)]
KEYS = ["group_lang", "group_source"]
#: Stands for the pooled remainder in a key; no text of a table begins with a zero character and "rest".
REST = "\x00rest"


def chi_square(level: float, p: int = P) -> float:
    """The quantile of the chi-square law of an even number of degrees of freedom."""
    above = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
    low, high = 0.0, 1.0
    while above(high) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - level else (low, mid)
    return high


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text; all 0 for null and for texts without a word."""
    words = WORD.findall(text) if text else []
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOL.findall(text)) if text else 0, 0, 0, 0, 0, 0)
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    repeated = 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if len(windows) < n - 2:
        free = 0  # first word that no repeated window has covered yet
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(free, i)
                free = i + 3
    return (n, sum(map(len, words)), len(SYMBOL.findall(text)), sum(lines.values()) - len(lines), repeated, sum(lines.values()),
            sum(len(w) > 1 and w.isupper() for w in words), sum(not w.isalnum() for w in words))


def with_counts(df: DataFrame, text_col: str = "text", into: str = "counts") -> DataFrame:
    """df with a struct of COUNTS of the whole text; null counts as empty."""
    if into.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {into}")

    @F.pandas_udf(COUNT_DDL)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return df.withColumn(into, counted(whole_text(text_col)))


def base_failed(counts: str = "counts") -> Column:
    """Fewer than 50 words, or over half of the words repeated."""
    n = F.col(f"{counts}.n_words")
    return (n < 50) | (100 * F.col(f"{counts}.n_repeat_words") > 50 * n)


def vector(counts: str = "counts") -> list[Column]:
    """The six transformed statistics as whole multiples of 1 / UNIT."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    n = F.greatest(c("n_words"), F.lit(1.0))
    root = lambda name, of=n: F.sqrt(c(name) / of)
    each = [F.log(F.greatest(c("word_chars"), F.lit(1.0)) / n), root("n_symbols"), root("n_repeat_words"),
            root("n_dup_lines", F.greatest(c("n_lines"), F.lit(1.0))), root("n_upper_words"), root("n_signed_words")]
    return [F.rint(e * UNIT).cast("long").alias(name) for e, name in zip(each, DIMS)]


# ---------------------------------------------------------------- groups


def group_sizes(vectors: DataFrame) -> DataFrame:
    """(lang, source, rows, group_lang, group_source): the group that the rows of each language and source belong to."""
    def pooled(df: DataFrame, old: list[str], new: list[Column]) -> DataFrame:
        size = df.groupBy(*old).agg(F.sum("rows").alias("size"))
        small = df.join(size, old).withColumn("small", F.col("size") < LEAST)
        return small.select("lang", "source", "rows", *[F.when(F.col("small"), n).otherwise(F.col(o)).alias(o) for o, n in zip(old, new)])

    # one row per language and source
    sizes = settle(vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    first = sizes.withColumns({"group_lang": F.col("lang"), "group_source": F.col("source")})
    by_lang = pooled(first, KEYS, [F.col("group_lang"), F.lit(REST)])
    return settle(pooled(by_lang, KEYS, [F.lit(REST), F.lit(REST)]), "groups")


# ---------------------------------------------------------------- one step: sums per distance bin


def distance(center: list[str], precision: list[str]) -> Column:
    """Squared Mahalanobis distance of the row's statistics."""
    d = [F.col(x) - F.col(c) for x, c in zip(DIMS, center)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col(q) for (i, j), q in zip(CROSS, precision)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def bin_of(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(2.0 ** -10)) * FINE).cast("int")


CENTER = [f"c{i}" for i in range(P)]
PRECISION = [f"q{k}" for k in range(len(CROSS))]
ESTIMATE_DDL = "group_lang string, group_source string, start int, det double, " + ", ".join(f"{c} double" for c in CENTER + PRECISION)


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(DIMS)],
            *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"t{k}") for k, (i, j) in enumerate(CROSS)]]


def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, inverse covariance and log-determinant from the sums of each row's group; SPREAD is added to the variances."""
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            n = max(1, int(r["n"]))
            mean = np.array([r[f"s{i}"] for i in range(P)], float) / n
            cov = np.zeros((P, P))
            for k, (i, j) in enumerate(CROSS):
                # whole numbers: the difference of products is exact before it is divided
                cov[i, j] = cov[j, i] = (int(r[f"t{k}"]) * n - int(r[f"s{i}"]) * int(r[f"s{j}"])) / (n * n)
            cov += np.diag([(s * UNIT) ** 2 for s in SPREAD])
            inverse = np.linalg.inv(cov)
            out.append([r["group_lang"], r["group_source"], r["start"], float(np.linalg.slogdet(cov)[1]), *mean, *(inverse[i, j] for i, j in CROSS)])
        yield pd.DataFrame(out, columns=["group_lang", "group_source", "start", "det", *CENTER, *PRECISION])


def estimated(sums_of: DataFrame) -> DataFrame:
    return settle(sums_of.mapInPandas(solve, ESTIMATE_DDL), "estimate")


def binned(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """Per group, start and distance bin the sums of its rows; `upto` are the rows up to and with the bin, `rows` all of the group."""
    # the estimates are one slim row per group and start; Spark sends them to all tasks where they are small
    near = vectors.join(estimate, KEYS).withColumn("bin", bin_of(distance(CENTER, PRECISION)))
    table = near.groupBy(*KEYS, "start", "bin").agg(*sums())
    w = Window.partitionBy(*KEYS, "start")
    return table.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("rows", F.sum("n").over(w))


def added(bins: DataFrame) -> DataFrame:
    names = ["n", *[f"s{i}" for i in range(P)], *[f"t{k}" for k in range(len(CROSS))]]
    return bins.groupBy(*KEYS, "start").agg(*[F.sum(c).alias(c) for c in names])


# ---------------------------------------------------------------- starts and steps


def starts(vectors: DataFrame) -> DataFrame:
    """Two estimates per group: plain moments (0), and medians with quartile ranges as deviations (1)."""
    plain = vectors.groupBy(*KEYS).agg(*sums()).withColumn("start", F.lit(0))
    # counts per value: at most a few thousand different values of each statistic, whatever the size of the group
    values = vectors.select(*KEYS, F.posexplode(F.array(*DIMS)).alias("dim", "value")).groupBy(*KEYS, "dim", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEYS, "dim")
    values = values.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("rows", F.sum("n").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("rows"), F.col("value")))
    middle = values.groupBy(*KEYS, "dim").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    wide = middle.groupBy(*KEYS).agg(*[F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for i in range(P) for c in ("low", "mid", "high")])
    deviation = [(F.col(f"high{i}") - F.col(f"low{i}")) / 1.349 for i in range(P)]
    variance = [d * d + (s * UNIT) ** 2 for d, s in zip(deviation, SPREAD)]
    det = variance[0] * 0.0
    for v in variance:
        det = det + F.log(v)
    robust = wide.select(*KEYS, F.lit(1).alias("start"), det.alias("det"), *[F.col(f"mid{i}").cast("double").alias(c) for i, c in enumerate(CENTER)],
                         *[(1 / variance[i] if i == j else F.lit(0.0)).alias(q) for (i, j), q in zip(CROSS, PRECISION)])
    return settle(estimated(plain).unionByName(robust), "starts")


def fit(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """One estimate per group (KEYS, centre, inverse covariance) from all rows of `vectors` (KEYS and DIMS).

    Every step reads the slim vectors once; the driver sees one number a step, by how much determinants still fall.
    """
    distinct = settle(vectors.select(*KEYS, *DIMS).distinct(), "vectors")
    estimate = starts(distinct)
    for _ in range(steps):
        bins = binned(distinct, estimate)
        # all bins up to the first that brings the rows to the share
        better = estimated(added(bins.where(F.col("upto") - F.col("n") < HALF * F.col("rows"))))
        falls = better.alias("b").join(estimate.alias("e"), [*KEYS, "start"]).agg(F.max(F.col("e.det") - F.col("b.det"))).first()[0]
        estimate = better
        if falls is None or abs(falls) < 1e-6:
            break
    best = settle(estimate.groupBy(*KEYS).agg(F.min_by("start", F.struct("det", "start")).alias("start")).join(estimate, [*KEYS, "start"]), "best")
    # the last estimate: rows within the ellipsoid that the median distance scales
    bins = binned(distinct, best)
    middle = F.min(F.when(F.col("upto") >= 0.5 * F.col("rows"), F.col("bin"))).over(Window.partitionBy(*KEYS, "start"))
    scale = F.greatest(F.lit(1.0), F.pow(2.0, (middle + 1) / F.lit(float(FINE))) / chi_square(0.5))
    inside = bins.withColumn("factor", scale).where(F.pow(2.0, F.col("bin") / F.lit(float(FINE))) <= F.col("factor") * chi_square(WITHIN))
    return estimated(added(inside))


def distances(df: DataFrame, lang_col: str = "lang", source_col: str = "source", counts: str = "counts", into: str = "distance") -> DataFrame:
    """df with the squared distance of each row from its group's estimate; null where base_failed.

    The estimates come from all rows that don't fail. Language and source are compared as texts, null as the empty text.
    """
    if into.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {into}")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # the given columns stay in one struct, so that none can hide a name used below
    rows = df.select(key(lang_col).alias("lang"), key(source_col).alias("source"), base_failed(counts).alias("failed"), *vector(counts),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"))
    sound = rows.where("not failed").select("lang", "source", *DIMS)
    groups = group_sizes(sound)
    grouped = sound.join(groups.drop("rows"), ["lang", "source"]).select(*KEYS, *DIMS)
    pool = groups.where(F.col("group_lang") == REST).agg(F.sum("rows")).first()[0]
    if pool is not None and pool < LEAST:
        # even all small groups together are too few: all rows speak for them
        everything = sound.select(*[F.lit(REST).alias(k) for k in KEYS], *DIMS)
        grouped = grouped.where(F.col("group_lang") != REST).unionByName(everything)
    estimate = groups.drop("rows").join(fit(grouped), KEYS)
    judged = rows.join(estimate, ["lang", "source"], "left")
    d2 = F.when(~F.col("failed"), distance(CENTER, PRECISION))
    return judged.select("given.*", d2.alias(into))


def reject_outliers(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that pass the base rule and are no outliers, with their columns."""
    counts = free_name(df, "counts")
    counted_rows = settle(with_counts(df, text_col, counts), "counts")
    far = free_name(counted_rows, "distance")
    return distances(counted_rows, lang_col, source_col, counts, far).where(F.col(far) <= chi_square(LEVEL)).drop(counts, far)


def op11_quality(spark, folder: str) -> DataFrame:
    """Counts, the base rule and the verdict for every row of documents.

    Null texts count as empty (no words, base_failed); an empty table gives an empty result; repeated rows are judged
    each, equal vectors count once in the estimate; extra columns of documents don't matter.
    """
    docs = documents(spark, folder).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    counts = settle(with_counts(docs).select("doc_id", "lang", "source", "counts"), "counts")
    out = distances(counts)
    return out.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"),
                      (~base_failed() & F.coalesce(F.col("distance") <= chi_square(LEVEL), F.lit(True))).alias("kept"), "distance")
