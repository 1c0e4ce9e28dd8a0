"""Removing passages that stand earlier in the corpus: suffix arrays over shards of candidate regions.

Anchors. Every window of WIDTH bytes has one anchor: the GRAM bytes in it with the least hash (the leftmost of equals).
Equal windows have equal anchors at the same offset. Neighbouring windows share anchors, so a text falls into regions:
an anchor and the windows that it stands for, some thirty on average.

Candidates. Regions meet by their anchor's hash. An anchor that occurs once has no repeated window. Regions of
equal bytes need no search: all but the earliest are covered. What is left, anchors with regions that differ, is
cut out of the texts and dealt to shards by anchor.

Shards. The regions of a shard are one string. Its suffix array is made by induced sorting, neighbours with a common
prefix of WIDTH bytes are equal windows, and each window but the earliest of its group is covered. The windows of an
anchor with very many differing regions are not sent to shards: their digests are aggregated, each window's earliest place
is found, and all later ones are covered, so that no task gets all copies of a passage that a third of all documents share.

Covered windows are gathered by document and cut out of the text. Order is by document and start; judgement is on the input only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import documents, filled, free_name, settle, whole_text
from colscope.llm.suffixarray import repeated_windows

WIDTH = 100
GRAM = 32
#: Bytes of a shard, about, and differing regions of an anchor up to which they stay together.
SHARD_BYTES, TOGETHER = 2_000_000, 20_000
#: Groups of documents that a window of such an anchor is looked for in.
SALTS = 64
#: Bytes of text that are worked on at once; places in it have PLACE bits.
PORTION, PLACE = 4_000_000, 24

MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h, power, width = data.astype(np.uint64) + np.uint64(1), MULTIPLIER, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & MASK, 2 * width
    return mixed(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def regions(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, content, start, windows) of the regions of one text of at least WIDTH bytes.

    content: a 57-bit hash of the bytes of all its windows, and the number of windows.
    """
    n = len(data) - WIDTH + 1
    anchors, starts, sizes, contents = [], [], [], []
    for at in range(0, n, PORTION):
        part = data[at: min(len(data), at + PORTION + WIDTH - 1)]
        grams = gram_hashes(part)
        keyed = (grams & np.uint64(MASK - (1 << PLACE) + 1)) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_least(keyed, WIDTH - GRAM + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        cut = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
        size = np.diff(np.r_[cut, len(place)])
        # hash of bytes [a, b): sum of byte * M^i over the range, divided by M^a
        powers, inverse = power_tables(len(part))
        total = np.r_[np.uint64(0), np.cumsum(mixed(part.astype(np.uint64) + np.uint64(7)) * powers[: len(part)])]
        content = mixed((total[cut + size + WIDTH - 1] - total[cut]) * inverse[cut])
        anchors.append(grams[place[cut]])
        starts.append(cut + at)
        sizes.append(size)
        contents.append((content >> np.uint64(7) << np.uint64(7)) | size.astype(np.uint64))
    return tuple(np.concatenate(x) for x in (anchors, contents, starts, sizes))


_POWERS: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^i and M^-i modulo 2^64 for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(m), np.uint64)], dtype=np.uint64)
                          for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def batch_regions(batch: pd.DataFrame) -> pd.DataFrame:
    """anchor, content, doc, start of the regions of a batch, and `first`: whether no equal region stands earlier in the batch."""
    rows = []
    for doc, text in zip(batch["doc"], batch["text"]):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(data) >= WIDTH:
            anchor, content, start, _ = regions(data)
            rows.append((anchor.view(np.int64), content.view(np.int64), np.full(len(start), doc, np.int64), start))
    if not rows:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("anchor", "content", "doc", "start")} | {"first": np.empty(0, bool)})
    anchor, content, doc, start = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((start, doc, content, anchor))
    fresh = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])]
    first = np.zeros(len(order), bool)
    first[order[fresh]] = True
    return pd.DataFrame({"anchor": anchor, "content": content, "doc": doc, "start": start, "first": first})


def numbered(df: DataFrame, id_col: str, text_col: str, name: str = "doc") -> DataFrame:
    """df with a number `name` in the order of documents: the identifier itself where each row has one of its own.

    Otherwise rows are numbered by identifier (null last), hash of the text and place; that table is settled.
    """
    rows, ids = df.agg(F.count("*"), F.countDistinct(F.col(id_col).cast("long"))).first()
    if rows == ids:
        return df.withColumn(name, F.col(id_col).cast("long"))
    order = [F.col(id_col).cast("long").asc_nulls_last(), F.xxhash64(whole_text(text_col))]
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")


def covered(docs: DataFrame) -> DataFrame:
    """doc, start, windows: all runs of windows of docs (doc, text) that stand earlier too. Runs may touch."""
    slim = docs.select("doc", "text")

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = batch_regions(b)
            yield found.loc[found["first"], ["anchor", "content", "doc", "start"]]

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = batch_regions(b)
            found = found[~found["first"]]
            yield pd.DataFrame({"doc": found["doc"], "start": found["start"], "windows": found["content"] & 127})

    met = slim.mapInPandas(firsts, "anchor long, content long, doc long, start long")
    same = Window.partitionBy("anchor").orderBy("content", "doc", "start")
    # the first row of each content is a representative; rows are sorted once
    marked = met.withColumn("new", (F.coalesce(F.lag("content").over(same) != F.col("content"), F.lit(True))).cast("int"))
    whole = Window.partitionBy("anchor")
    marked = marked.withColumn("contents", F.sum("new").over(whole)).withColumn("rows", F.count("*").over(whole)).where("rows > 1")
    marks = settle(marked.where("new = 0 or contents > 1").select("anchor", "doc", "start", F.col("content").bitwiseAND(127).alias("windows"), "new", "contents"), "marks")
    copies = marks.where("new = 0").select("doc", "start", "windows")
    open_regions = marks.where("new = 1")
    spread = F.col("contents") > TOGETHER
    total, spread_out = open_regions.agg(F.sum(F.when(~spread, F.col("windows") + WIDTH - 1)), F.count_if(spread)).first()
    shards = max(1, -(-(total or 0) // SHARD_BYTES))

    def asked(regions: DataFrame) -> DataFrame:
        return slim.join(regions.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("asked")), "doc")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, asked in zip(b["doc"], b["text"], b["asked"]):
                data = text.encode("utf-8", "replace")
                out += [(r["anchor"], doc, r["start"], data[r["start"]: r["start"] + r["windows"] + WIDTH - 1]) for r in asked]
            if out:
                yield pd.DataFrame(out, columns=["anchor", "doc", "start", "bytes"])

    cut = asked(open_regions.where(~spread)).mapInPandas(cut_out, "anchor long, doc long, start long, bytes binary")
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc", "start"], ignore_index=True)
        sizes = group["bytes"].str.len().to_numpy()
        text = np.frombuffer(b"".join(group["bytes"]), np.uint8)
        begins = np.cumsum(sizes) - sizes
        valid = np.ones(len(text), bool)
        for k in range(1, WIDTH):
            valid[begins + sizes - k] = False
        found = repeated_windows(text, valid, WIDTH)
        region = np.searchsorted(begins, found, side="right") - 1
        fresh = np.r_[True, (np.diff(found) != 1) | (np.diff(region) != 0)] if len(found) else np.empty(0, bool)
        at = np.flatnonzero(fresh)
        return pd.DataFrame({"doc": group["doc"].to_numpy()[region[at]], "start": group["start"].to_numpy()[region[at]] + found[at] - begins[region[at]],
                             "windows": np.diff(np.r_[at, len(found)])})

    shape = "doc long, start long, windows long"
    searched = cut.groupBy("shard").applyInPandas(search, shape)
    found = copies.union(searched).union(slim.mapInPandas(later, shape))
    return found.union(equal_windows(asked(open_regions.where(spread)))) if spread_out else found


def equal_windows(docs: DataFrame) -> DataFrame:
    """doc, start, windows: the windows of the regions `asked` of docs that stand earlier in these too.

    Equal windows of a batch meet before they are shuffled, as 16 bytes each. The earliest of all is found by a partial aggregation,
    and told to the others by document groups, so that no task has all copies of a window.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests, docs, starts, size = [], [], [], 0
            for doc, text, asked in zip(b["doc"], b["text"], b["asked"]):
                data = text.encode("utf-8", "replace")
                at = [i for r in asked for i in range(r["start"], r["start"] + r["windows"])]
                digests += [xxhash.xxh3_128_digest(data[i: i + WIDTH]) for i in at]
                docs.append(np.full(len(at), doc, np.int64))
                starts.append(np.array(at, np.int64))
                size += len(at)
                if size > PORTION >> 2:
                    yield met(digests, docs, starts)
                    digests, docs, starts, size = [], [], [], 0
            if size:
                yield met(digests, docs, starts)

    def met(digests: list[bytes], docs: list[np.ndarray], starts: list[np.ndarray]) -> pd.DataFrame:
        high, low = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        doc, start = np.concatenate(docs), np.concatenate(starts)
        order = np.lexsort((start, doc, low, high))
        high, low, doc, start = high[order], low[order], doc[order], start[order]
        first = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        return pd.DataFrame({"high": high, "low": low, "doc": doc, "start": start, "first": first})

    rows = settle(docs.mapInPandas(windows, "high long, low long, doc long, start long, first boolean"), "windows")
    place = F.struct("doc", "start")
    some = rows.where("first").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    parts = some.groupBy("high", "low", "salt").agg(F.min(place).alias("least"), F.count("*").alias("rows"))
    earliest = parts.groupBy("high", "low").agg(F.min("least").alias("earliest"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
    told = parts.select("high", "low", "salt").join(earliest, ["high", "low"])
    late = some.join(told, ["high", "low", "salt"]).where(place != F.col("earliest"))
    return late.select("doc", "start").union(rows.where("not first").select("doc", "start")).withColumn("windows", F.lit(1).cast("long"))


def joined_runs(starts: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of bytes that the windows cover; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], starts[order] + windows[order] + WIDTH - 1
    reach = np.maximum.accumulate(b)
    fresh = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return list(zip(a[fresh].tolist(), np.r_[reach[fresh[1:] - 1], reach[-1]].tolist()))


def with_runs(docs: DataFrame) -> DataFrame:
    """docs with `runs`, the covered windows of each as packed numbers (null where there are none)."""
    runs = covered(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return docs.join(runs, "doc", "left")


def removed_of(runs) -> list[tuple[int, int]]:
    if runs is None or not len(runs):
        return []
    return joined_runs(np.array([r["start"] for r in runs], np.int64), np.array([r["windows"] for r in runs], np.int64))


def keep(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in removed:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null and empty texts and texts under WIDTH bytes lose nothing. Rows that repeat an identifier are documents of
    their own, in the order of their texts' hashes; other columns are not read.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    docs = with_runs(numbered(slim, "doc_id", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filled(batches):
            rows = []
            for text, runs in zip(b["text"], b["runs"]):
                data, gone = text.encode("utf-8", "replace"), removed_of(runs)
                rows.append((len(data), sum(z - a for a, z in gone), len(gone), hashlib.sha256(keep(data, gone)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text", "runs").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the passages cut out of its texts. Bytes of a character that is cut in two go with the cut."""
    doc, runs = free_name(df, "doc"), free_name(df, "row_runs")
    docs = numbered(df, id_col, text_col, doc)
    found = covered(docs.select(F.col(doc).alias("doc"), whole_text(text_col).alias("text")))
    found = found.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("start", "windows")).alias(runs))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if not (gone := removed_of(r)) else keep(t.encode("utf-8", "replace"), gone).decode("utf-8", "ignore")
                          for t, r in zip(texts, lists)], dtype=object)

    done = docs.join(found, doc, "left")
    kept = F.when(F.col(runs).isNull(), F.col(text_col).cast("string")).otherwise(cut(whole_text(text_col), F.col(runs)))
    return done.withColumn(text_col, kept).select(*df.columns)


def op7_passages(spark, folder: str) -> DataFrame:
    return removals(documents(spark, folder))
