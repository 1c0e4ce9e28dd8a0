"""A probabilistic suffix tree over words: contexts of variable length, kept where they say more than their suffix.

Counting. Words are counted over all training documents, then sequences of two and of three words. A sequence
counts from LEAST occurrences on, whatever the size of the corpus, so the tree grows with it. The sequences of a length are the
contexts of the next one. A sequence is only counted where both the one without its last and the one without its
first word have LEAST occurrences, which a bit map of bounded size tells (it may err to that side only).
Longer contexts stand in the repeated runs of the texts. They are grown many lengths at a time: an occurrence takes the words
before its context along, equal ones are added up, and all that end in the same context (or, if it is very common, in the
same one and a part of the words before it) meet in one group, which is gone through length by length. Each round reaches three times as far back, so a hundred lengths take four.

Divergence. A context is kept if its next-word distribution differs from its suffix's by more than it costs to state:
n(s) KL(P(.|s) || P(.|suffix)) > next words * ln(n(s)) / 2. Suffixes of kept contexts are kept. Contexts grow until no
context of a length is kept. A context that one word always follows is closed, and not grown, once no longer one can pass
that test (see `closed`); what is kept is the same.

Smoothing. P(w|s) = (n(sw) + t P(w|suffix)) / (n(s) + t) for the t next words told apart; what is left is shared
out by the suffix's distribution over all others. The root is the add-one distribution over all
training words and one class of unknown words. Each token is scored at the longest kept suffix of its history.

Scoring. log P(w|s) is the sum over all kept suffixes of s of what each adds to the one before: log P(w|s) - log P(w|suffix)
where w is told apart, and the logarithm of the share of the rest where it isn't. So a sequence has one
term, wherever it stands: its back-off as a context and, as a context and its next word, what that adds to the
back-off. Terms are a written table that a text's sequences are joined with. Tables that nothing reads again are deleted. Sequences that make up HOT_SHARE of all
training tokens (at most 1 / HOT_SHARE of a length) are sent to all tasks instead, and are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.session import local_table
from colscope.llm.common import documents, filled, forget, remainder, settle_lean as settle, small_batches, whole_text
from colscope.llm.superminhash import WordHashes
from colscope.llm.tokens import portions

#: Share of all tokens from which on a sequence's term is sent to all tasks; the result does not depend on it.
HOT_SHARE = 2e-6
#: Occurrences that a context and a next word need.
LEAST = 3
#: Bits of a bit map of sequences: 16 for each, up to 2 ** MOST_BITS; a fuller one lets more through, and loses nothing.
MOST_BITS = 28
#: Lengths of contexts that are counted in whole texts; longer ones are counted in what repeats of the texts.
TEXT_PASSES = 2
#: A round of windows reaches so many times as far back as the one before.
REACH = 3
#: Contexts whose windows meet in one group, and bytes of these windows, about.
GROUP, GROUP_BYTES = 4000, 1 << 24
#: Contexts that are marked in one group, about.
MARKED = 1 << 17
#: A bit map is made in 2 ** SLICES parts.
SLICES = 8
#: The token after a document's last word: the hash of no letters, which no word has.
END = b""
#: Its hash; no context has it, so it also stands for the words before a text's or run's first one.
NO_WORD = np.uint64(WordHashes()[END]).view(np.int64)
#: Bytes up to which words are hashed side by side.
LONG = 64
#: White space, A-Z in lower case, and the lowest k bytes of eight.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
ONES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(first: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hashes of sequences, from those of their first words and of the sequences without them."""
    p, s = first.astype(np.int64).view(np.uint64), suffix.astype(np.int64).view(np.uint64)
    x = (p ^ (p >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + s * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


@dataclass
class BitMap:
    """Which hashes may be in a set; bits are told by a hash's leading bits."""

    bits: int
    data: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def bit_map(keys: DataFrame) -> BitMap:
    """The bit map of a column `key`."""
    bits = min(MOST_BITS, max(SLICES + 3, math.ceil(math.log2(16 * keys.count() + 1))))
    size = 1 << (bits - SLICES)

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        places = group["key"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        flags = np.zeros(size, bool)
        flags[places & np.uint64(size - 1)] = True
        return pd.DataFrame({"slice": [int(places[0]) >> (bits - SLICES)], "data": [np.packbits(flags).tobytes()]})

    sliced = keys.select("key", F.shiftrightunsigned("key", 64 - SLICES).alias("slice"))
    data = np.zeros((1 << SLICES, size >> 3), np.uint8)
    made = settle(sliced.groupBy("slice").applyInPandas(mark, "slice long, data binary"), "bits")  # what it has shuffled goes with it
    for r in made.toLocalIterator():  # 2 ** SLICES rows
        data[r["slice"]] = np.frombuffer(r["data"], np.uint8)
    forget(made)
    return BitMap(bits, data.reshape(-1))


@dataclass
class Level:
    """A level in memory, to look at small trees; numbers of contexts are places in `contexts`."""

    contexts: np.ndarray  # sorted hashes
    first: np.ndarray  # hashes of their first words
    kept: np.ndarray
    back: np.ndarray  # log10 share of the suffix's distribution
    suffix: np.ndarray  # number of the suffix in the level before
    next: np.ndarray  # sorted hashes of a context and its next word
    next_log: np.ndarray  # log10 P(word | context)


@dataclass
class Tree:
    head: np.ndarray  # sorted hashes of the frequent words
    head_counts: np.ndarray
    tokens: int
    words: int
    #: Words in the longest contexts.
    depth: int = 0
    #: For some lengths of contexts each (sequences: depth, key, p, s, n, prob, less; contexts: depth, key, first, s, held, back, kept, open).
    tables: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    terms: DataFrame | None = None  # key, n, term
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sorted hashes of the frequent sequences
    hot_terms: np.ndarray = field(default_factory=lambda: np.empty(0))
    known: BitMap | None = None  # of the sequences that have a term

    @property
    def log_total(self) -> float:
        return math.log10(self.tokens + self.words + 1)

    @property
    def root_log(self) -> np.ndarray:
        return np.log10(self.head_counts + 1.0) - self.log_total

    @cached_property
    def levels(self) -> list[Level]:
        """The whole tree, collected."""
        out: list[Level] = []
        for sequences, contexts in self.tables:
            some, following = contexts.toPandas(), sequences.toPandas()
            for d in sorted(some["depth"].unique()):
                c, g = (t[t["depth"] == d].sort_values("key") for t in (some, following))
                suffix = find(out[-1].contexts, c["s"].to_numpy(np.int64)) if out else np.zeros(len(c), np.int64)
                out.append(Level(*(c[x].to_numpy(np.int64) for x in ("key", "first")), c["kept"].to_numpy(bool), c["back"].to_numpy(float), suffix,
                                 g["key"].to_numpy(np.int64), np.log10(g["prob"].to_numpy(float))))
        return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they aren't in it."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def tokens_of(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, the text each is in); every text ends with an end token. known: hashes of words over LONG bytes.

    All words of the texts are hashed at once, eight bytes of each in a step.
    """
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b" " * 8]), np.uint8)
    edges = np.flatnonzero(np.diff(SPACE[data])) + 1  # data begins and ends with white space
    starts, stops = edges[::2], edges[1::2]
    length = stops - starts
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    data = LOWER[data]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    hashes = length.astype(np.uint64)
    left, at, rest = slice(None), starts, length
    for _ in range(LONG // 8):
        block = eight[at] & ONES[np.minimum(rest, 8)]
        x = (hashes[left] ^ block) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes[left] = x ^ (x >> np.uint64(32))
        more = rest > 8
        left = np.flatnonzero(more) if isinstance(left, slice) else left[more]
        at, rest = at[more] + 8, rest[more] - 8
    for k in left:
        hashes[k] = known[data[starts[k]: stops[k]].tobytes()]
    sizes = np.bincount(of, minlength=len(raw)) + 1
    tokens = np.full(len(hashes) + len(raw), known[END], np.uint64)
    tokens[np.arange(len(hashes)) + of] = hashes
    return tokens.view(np.int64), np.repeat(np.arange(len(raw)), sizes)


def sequences_of(word: np.ndarray, doc: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 on the hashes of the sequences that end at each token, and whether they lie within its text."""
    keys, whole = word, np.ones(len(word), bool)
    yield keys, whole
    for k in range(1, length):
        none = np.zeros(min(k, len(word)), np.int64)
        keys, whole = mixed(np.r_[none, word[:-k]], keys), np.r_[none > 0, doc[k:] == doc[:-k]]
        yield keys, whole


def read_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and the text (or run) each is in, of a portion at a time."""
    known = WordHashes()
    for b in filled(batches):
        if "run" in b:
            sizes = b["run"].str.len().to_numpy() >> 3
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) >> 18)) + 1  # some 2 ** 18 tokens at a time
            for runs, some in zip(np.split(b["run"].to_numpy(), cuts), np.split(sizes, cuts)):
                yield np.frombuffer(b"".join(runs), np.int64), np.repeat(np.arange(len(some)), some)
        else:
            for texts in portions(b["text"]):
                yield tokens_of(texts, known)


def buckets_for(tokens: int) -> int:
    """Into how many buckets what is made of so many tokens is dealt: some 2 ** 18 of them each."""
    return max(64, tokens >> 18)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def bucket_column(name: str, buckets: int) -> Column:
    """bucket_of of a column."""
    return F.pmod(F.shiftrightunsigned(name, 16), F.lit(buckets)).cast("int")


def packed(keys: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """A row for each bucket of the keys, with the bytes of its entries' columns."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    return pd.DataFrame({"bucket": used} | {c: [x[a:b].tobytes() for a, b in zip(edges[used], edges[used + 1])] for c, x in ((c, x[order]) for c, x in columns.items())})


def unpacked(column: pd.Series, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def summed(key: np.ndarray, columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(distinct keys, columns of each, sum of n or count)."""
    order = np.argsort(key)
    key = key[order]
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    size = np.diff(np.r_[fresh, len(key)]) if n is None else np.add.reduceat(n[order], fresh) if len(fresh) else n
    return key[fresh], *(x[order[fresh]] for x in columns), size


def gathered(batches: Iterator[pd.DataFrame], found, most: int) -> Iterator[list[np.ndarray]]:
    """What found(tokens, texts) gives for the texts of batches, some `most` rows at a time."""
    some, size = [], 0
    for word, doc in read_tokens(batches):
        some.append(found(word, doc))
        size += len(some[-1][0])
        if size > most:
            yield [np.concatenate(x) for x in zip(*some)]
            some, size = [], 0
    if some:
        yield [np.concatenate(x) for x in zip(*some)]


def repeated_runs(training: DataFrame, told: DataFrame, opened: BitMap) -> DataFrame:
    """run: the tokens of each stretch of a text in which all sequences of TEXT_PASSES + 1 words are told, and the next token, settled.

    All longer contexts with LEAST occurrences stand in these. A run ends with the last token behind an open context, and has one.
    """
    length = TEXT_PASSES + 1
    shared = training.sparkSession.sparkContext.broadcast((bit_map(told), opened))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some_told, some_open = shared.value
        for word, doc in read_tokens(batches):
            *_, (shorter, _), (keys, whole) = sequences_of(word, doc, length)
            ends = np.flatnonzero(whole & some_told.holds(keys))
            ends = ends[ends + 1 < len(word)]
            ends = ends[doc[ends + 1] == doc[ends]]
            if len(ends):
                first = np.flatnonzero(np.r_[True, (np.diff(ends) != 1) | (doc[ends[1:]] != doc[ends[:-1]])])
                last = np.maximum.reduceat(np.where(some_open.holds(shorter[ends]), ends, -1), first)
                yield pd.DataFrame({"run": [word[a - length + 1: b + 2].tobytes() for a, b in zip(ends[first], last) if b >= 0]})

    runs = settle(training.mapInPandas(cut, "run binary"), "runs")
    shared.unpersist()
    return runs


def count_words(training: DataFrame) -> DataFrame:
    """word (hash), n over all training tokens, settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (word,) in gathered(batches, lambda word, doc: (word,), 1 << 20):
            key, n = summed(word, [])
            yield pd.DataFrame({"word": key, "n": n})

    return settle(training.mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def count_next(training: DataFrame, shorter: DataFrame, depth: int, buckets: int) -> DataFrame:
    """key, first, p, s, n of the sequences of depth + 1 words with LEAST occurrences, settled; p and s lack the last and the first word."""
    shared = training.sparkSession.sparkContext.broadcast(bit_map(shorter))
    columns = ["p", "s"] if depth == 1 else ["first", "p", "s"]  # the context of one word is the first word

    def found(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        *_, (keys, whole) = sequences_of(word, doc, depth)
        often = whole & shared.value.holds(keys)
        ends = np.flatnonzero(often[1:] & often[:-1] & (doc[1:] == doc[:-1])) + 1
        return (word[ends - depth], keys[ends - 1], keys[ends])[-len(columns):]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in gathered(batches, found, 1 << 20):
            key, *part, n = summed(mixed(part[0], part[-1]), part)
            yield packed(key, buckets, dict(zip(columns, part)) | {"n": n.astype(np.int32)})

    def often(group: pd.DataFrame) -> pd.DataFrame:
        part = [unpacked(group[c]) for c in columns]
        key, *part, n = summed(mixed(part[0], part[-1]), part, unpacked(group["n"], np.int32).astype(np.int64))
        some = n >= LEAST
        return pd.DataFrame({"key": key[some], "first": part[0][some], "p": part[-2][some], "s": part[-1][some], "n": n[some]})

    rows = training.mapInPandas(run, ", ".join(["bucket int", *(f"{c} binary" for c in [*columns, "n"])]))
    told = settle(rows.groupBy("bucket").applyInPandas(often, "key long, first long, p long, s long, n long"), "told")
    shared.unpersist()
    return told


def log_next(tree: Tree, depth: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 P(word | context) for contexts of one length (numbers in its level) and frequent words."""
    return log_and_keys(tree, depth, context, word)[0]


def log_and_keys(tree: Tree, depth: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and the hashes of the contexts with the words."""
    if depth == 0:
        return tree.root_log[word], tree.head[word]
    level = tree.levels[depth - 1]
    below, shorter = log_and_keys(tree, depth - 1, level.suffix[context], word)
    keys = mixed(level.first[context], shorter)
    at = find(level.next, keys)
    return np.where(at >= 0, level.next_log[at], level.back[context] + below), keys


def closed(held, told, seen, prob, ln):
    """Whether no longer context can be kept: one word, of probability prob, always follows.

    Behind a longer context with n of the occurrences, that word's probability is (n + prob) / (n + 1), and no less after that. So it gains
    n ln((n + prob) / (n + 1) / prob) <= n n / (n + 1) * (1 - prob) / prob, which has to exceed ln(n) / 2. The most it is of that is where n is largest.
    Numbers of a column or of an array.
    """
    return (told == 1) & (seen == held) & ((1 - prob) / prob * held * held / (held + 1) < ln(held) / 2 * (1 - 1e-9))


def smooth(told: DataFrame, shorter: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(told with prob and less, contexts); told is deleted. shorter: key, first, s, n, prob of the sequences that are a word shorter.

    prob is a next word's probability behind its context, less behind the context's suffix, where it is told apart too.
    Contexts: key, first (word), s (suffix), held (occurrences), back (log10 share of the suffix's distribution), kept, open (not closed).
    """
    sizes = told.groupBy("p").agg(F.count("*").alias("told"), F.sum("n").alias("seen")).join(
        shorter.select(F.col("key").alias("p"), F.col("n").alias("held"), F.col("first").alias("context_first"), F.col("s").alias("context_s")), "p")
    both = told.join(sizes, "p").join(shorter.select(F.col("key").alias("s"), F.col("prob").alias("less")), "s")
    both = settle(both.withColumn("prob", (F.col("n") + F.col("told") * F.col("less")) / (F.col("held") + F.col("told"))), "next")
    forget(told)
    sums = both.groupBy("p").agg(
        *(F.max(c).alias(c) for c in ("held", "told", "seen", "context_first", "context_s")), F.sum("prob").alias("prob"), F.sum("less").alias("less"),
        F.sum(F.col("n") * F.ln(F.col("prob") / F.col("less"))).alias("gain"))
    left, left_below = (F.greatest(F.lit(1e-12), 1 - F.col(c)) for c in ("prob", "less"))
    contexts = sums.withColumn("back", F.log10(left / left_below))
    rest = F.greatest(F.lit(0), F.col("held") - F.col("seen"))
    kept = F.col("gain") + rest * F.col("back") * math.log(10) > F.col("told") * F.ln(F.greatest(F.lit(2), F.col("held"))) / 2
    contexts = contexts.select(
        F.lit(depth).alias("depth"), F.col("p").alias("key"), F.col("context_first").alias("first"), F.col("context_s").alias("s"), "held", "back", kept.alias("kept"),
        (~closed(*(F.col(c) for c in ("held", "told", "seen", "prob")), F.ln)).alias("open"))
    return both.select(F.lit(depth).alias("depth"), "key", "first", "p", "s", "n", "prob", "less"), settle(contexts, "contexts")


GROWN = "root long, depth int, context boolean, key long, first long, p long, s long, n long, prob double, less double, kept boolean, open boolean"


def grow(rows: pd.DataFrame, known: pd.DataFrame, width: int, depth: int) -> pd.DataFrame:
    """All longer contexts (n: held, prob: back) and sequences, of up to width more words, of some contexts of depth words.

    rows: bytes of root (context), next (context and next word), window (words before it), n. known: p, key, prob of the told next words of open contexts.
    All windows of a context that is a word longer have to be among the rows. That context is what the result calls a root.
    """
    known = known.sort_values("key")
    root, after, n, window = (unpacked(rows[c]) for c in ("root", "next", "n", "window"))
    there = find(np.unique(known["p"].to_numpy(np.int64)), root) >= 0  # a bit map may let others through
    root, after, n, window = root[there], after[there], n[there], window.reshape(len(root), width)[there]
    at = find(known["key"].to_numpy(np.int64), after)
    low = np.where(at >= 0, known["prob"].to_numpy(float)[at], np.nan) if len(root) else np.empty(0)
    context, left = root, np.arange(len(root))
    root = mixed(window[:, 0], root)
    out: dict[str, list[np.ndarray]] = {c.split()[0]: [] for c in GROWN.split(", ")}

    def add(size: int, **columns) -> None:
        for c, x in columns.items():
            out[c].append(np.broadcast_to(x, size))

    for j in range(width):
        word = window[left, j]
        longer = mixed(word, context)
        _, of = np.unique(longer, return_inverse=True)
        often = (word != NO_WORD) & (np.bincount(of, n)[of] >= LEAST) if len(of) else np.empty(0, bool)
        if not often.any():
            break
        left, word, longer, shorter, below, root, n, low = (x[often] for x in (left, word, longer, context, after, root, n, low))
        context, start, of = np.unique(longer, return_index=True, return_inverse=True)
        held = np.bincount(of, n).astype(np.int64)
        after, begin, which = np.unique(mixed(word, below), return_index=True, return_inverse=True)
        times = np.bincount(which, n).astype(np.int64)
        told = np.flatnonzero(times >= LEAST)
        p, less, times = of[begin[told]], low[begin[told]], times[told]
        count, seen = np.bincount(p, minlength=len(context)), np.bincount(p, times, len(context)).astype(np.int64)
        prob = (times + count[p] * less) / (held[p] + count[p])
        sums, sums_below, gain = (np.bincount(p, x, len(context)) for x in (prob, less, times * np.log(prob / less)))
        back = np.log10(np.maximum(1e-12, 1 - sums) / np.maximum(1e-12, 1 - sums_below))
        kept = gain + (held - seen) * back * math.log(10) > count * np.log(held) / 2
        opened = (count > 0) & ~closed(held, count, seen, np.where(count, sums, 1), np.log)
        c = np.flatnonzero(count)
        add(len(c), root=root[start[c]], depth=depth + j + 1, context=True, key=context[c], first=word[start[c]], p=0, s=shorter[start[c]],
            n=held[c], prob=back[c], less=0.0, kept=kept[c], open=opened[c])
        add(len(told), root=root[begin[told]], depth=depth + j + 1, context=False, key=after[told], first=word[begin[told]], p=context[p],
            s=below[begin[told]], n=times, prob=prob, less=less, kept=False, open=False)
        probs = np.full(len(after), np.nan)
        probs[told] = prob
        on = opened[of]
        left, context, after, low, root, n = left[on], longer[on], after[which[on]], probs[which[on]], root[on], n[on]
    return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})


def longer_contexts(runs: DataFrame, maps: dict[int, BitMap], sequences: DataFrame, contexts: DataFrame, depth: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(sequences, contexts) of contexts of up to width more words than depth, in one settled table. maps: open contexts by their length, up to depth."""
    spark = runs.sparkSession
    shared = spark.sparkContext.broadcast(maps)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some, size = [], 0
        for word, doc in read_tokens(batches):
            for part in found(word, doc):
                some.append(part)
                size += len(part[0]) * (width + 4)
                if size > 1 << 20:
                    yield distinct(some)
                    some, size = [], 0
        if some:
            yield distinct(some)

    def found(word: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        at = np.arange(len(word))

        def before(k: int) -> np.ndarray:  # the k-th word before, in the same run
            there = at >= k
            return np.where(there & (doc[at - k * there] == doc[at]), word[at - k * there], NO_WORD)

        at = at[before(TEXT_PASSES + 1) != NO_WORD]
        root = before(1)
        for k in range(2, depth + 1):
            ahead = before(k)
            at, root = at[ahead != NO_WORD], mixed(ahead, root)[ahead != NO_WORD]
            if k in shared.value:
                on = shared.value[k].holds(root)
                at, root = at[on], root[on]
        on = before(depth + 1) != NO_WORD
        places, roots = at[on], root[on]
        step = (1 << 21) // (width + 4) + 1
        for i in range(0, len(places), step):
            at, root = places[i: i + step], roots[i: i + step]
            after = word[at]
            for k in range(1, depth + 1):
                after = mixed(before(k), after)
            window = np.stack([before(depth + j) for j in range(1, width + 1)], 1)
            whole = after
            for j in range(width):
                whole = mixed(window[:, j], whole)
            yield whole, root, after, window

    def dealt(root: np.ndarray, window: np.ndarray) -> np.ndarray:
        """What a window's bucket is told by: its context, or that and a part of a hot one's windows, told by the word before it."""
        hot = find(hot_roots, root)
        some = np.flatnonzero(hot >= 0)
        part = (mixed(window[some, 0], root[some]).view(np.uint64) >> np.uint64(40)) % parts[hot[some]].astype(np.uint64)
        keys = root.copy()
        keys[some] = mixed(part.view(np.int64), root[some])
        return keys

    def distinct(some: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        whole, root, after, window = (np.concatenate(x) for x in zip(*some))
        _, start, n = np.unique(whole, return_index=True, return_counts=True)
        return packed(dealt(root[start], window[start]), groups, {"root": root[start], "next": after[start], "window": window[start], "n": n.astype(np.int64)})

    opened = contexts.where((F.col("depth") == depth) & F.col("open")).select(F.col("key").alias("p"), "held")
    most = max(1, GROUP_BYTES // (8 * (width + 3)))  # windows of a group
    count, held = opened.agg(F.count("*"), F.sum("held")).first()
    groups = max(32, count // GROUP, (held or 0) // most)
    hot = opened.where(F.col("held") > most).toPandas().sort_values("p")  # at most a row for each group
    hot_roots, parts = hot["p"].to_numpy(np.int64), -(-hot["held"].to_numpy(np.int64) // most)
    known = sequences.where(F.col("depth") == depth).join(opened, "p", "left_semi").select("p", "key", "prob")
    if len(hot):  # what is told of a hot context goes to all of its parts
        every = np.repeat(hot_roots, parts)
        part = np.arange(len(every)) - np.repeat(np.cumsum(parts) - parts, parts)
        to = local_table(spark, list(zip(every.tolist(), mixed(part, every).tolist())), "p bigint, deal bigint")
        known = known.join(F.broadcast(to), "p", "left").withColumn("deal", F.coalesce("deal", "p"))
    else:
        known = known.withColumn("deal", F.col("p"))
    long_enough = runs.where(F.length("run") >= 8 * (depth + 2))  # a longer context and its next word
    rows = long_enough.mapInPandas(windows, "bucket int, root binary, next binary, window binary, n binary").groupBy("bucket")
    grown = settle(rows.cogroup(known.groupBy(bucket_column("deal", groups).alias("bucket"))).applyInPandas(lambda a, b: grow(a, b, width, depth), GROWN), "longer")
    shared.unpersist()
    return (grown.where(~F.col("context")).select("depth", "key", "first", "p", "s", "n", "prob", "less"),
            grown.where("context").select("root", "depth", "key", "first", "s", F.col("n").alias("held"), F.col("prob").alias("back"), "kept", "open"))


def with_suffixes(contexts: DataFrame, longer: DataFrame | None) -> DataFrame:
    """contexts, settled, with those kept that are suffixes of kept ones, in the table or among longer (the next table)."""
    if longer is not None:
        needed = longer.where("kept").select(F.col("s").alias("key")).distinct().withColumn("needed", F.lit(True))
        contexts = contexts.join(needed, "key", "left").withColumn("kept", F.col("kept") | F.coalesce("needed", F.lit(False))).drop("needed")
    if "root" not in contexts.columns:
        return settle(contexts, "contexts")

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["depth", "key"])
        kept, key, s = group["kept"].to_numpy(bool).copy(), group["key"].to_numpy(np.int64), group["s"].to_numpy(np.int64)
        edges = np.r_[0, np.flatnonzero(np.diff(group["depth"])) + 1, len(group)]
        for a, b, c in reversed(list(zip(edges, edges[1:], edges[2:]))):
            kept[a + np.searchsorted(key[a:b], s[b:c][kept[b:c]])] = True
        return group.assign(kept=kept)

    most = max(contexts.sparkSession.sparkContext.defaultParallelism * 4, contexts.count() // MARKED)
    groups = contexts.withColumn("group", F.pmod("root", F.lit(most)))
    return settle(groups.groupBy("group").applyInPandas(mark, groups.schema).drop("group"), "contexts")


def fit(df: DataFrame, text_col: str = "text", depth: int | None = None) -> tuple[Tree, DataFrame]:
    """(tree, counts of all words) of a table of training texts. An empty table gives a tree that knows only unknown words.

    depth: words in the longest context, for those who want a bound.
    """
    training = df.select(whole_text(text_col).alias("text"))
    counts = count_words(training)
    tokens, words = counts.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    often = F.col("n") >= max(LEAST, HOT_SHARE * tokens)
    head = counts.where(often).toPandas().sort_values("word")  # at most 1 / HOT_SHARE rows
    tree = Tree(head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64), tokens, words)
    shorter = counts.where(F.col("n") >= LEAST).select(
        F.col("word").alias("key"), F.col("word").alias("first"), F.lit(0).cast("long").alias("s"), "n", ((F.col("n") + 1) / F.lit(float(tokens + words + 1))).alias("prob"))
    maps, runs = {}, None
    while depth is None or tree.depth < depth:
        if tree.depth < TEXT_PASSES:
            width = 1
            sequences, contexts = smooth(count_next(training, shorter, tree.depth + 1, buckets_for(tokens)), shorter, tree.depth + 1)
            shorter = sequences
        else:
            width = (REACH - 1) * tree.depth if depth is None else min((REACH - 1) * tree.depth, depth - tree.depth)
            maps[tree.depth] = bit_map(contexts.where((F.col("depth") == tree.depth) & F.col("open")).select("key"))
            if runs is None:
                runs = repeated_runs(training, sequences, maps[tree.depth])
            sequences, contexts = longer_contexts(runs, maps, sequences, contexts, tree.depth, width)
        lengths = {r["depth"] for r in contexts.where("kept").select("depth").distinct().collect()}
        end = next(d for d in range(tree.depth + 1, tree.depth + width + 2) if d not in lengths)  # no context of this length is kept, or none was asked for
        if end == tree.depth + 1:
            forget(sequences)
            forget(contexts)
            break
        within = F.col("depth") < end
        tree.tables.append((sequences.where(within), contexts.where(within)))
        if end <= tree.depth + width:
            tree.depth = end - 1
            break
        tree.depth += width
    if runs is not None:
        forget(runs)
    parts, longer = [], None
    for at in range(len(tree.tables) - 1, -1, -1):
        sequences, contexts = tree.tables[at]
        marked = with_suffixes(contexts, longer)
        if "root" not in contexts.columns:
            forget(contexts)
        tree.tables[at] = sequences, marked
        kept, longer = marked.where("kept"), marked
        parts.append(kept.select("key", F.col("held").alias("n"), F.col("back").alias("term")))
        added = sequences.join(kept.select(F.col("key").alias("p"), "back"), "p")
        parts.append(added.select("key", "n", (F.log10(F.col("prob") / F.col("less")) - F.col("back")).alias("term")))
    if parts:
        terms = parts[0]
        for p in parts[1:]:
            terms = terms.union(p)
        tree.terms = settle(terms.groupBy("key").agg(F.max("n").alias("n"), F.sum("term").alias("term")), "terms")
        hot = tree.terms.where(often).toPandas().sort_values("key")  # at most 1 / HOT_SHARE rows of a length
        tree.hot, tree.hot_terms = hot["key"].to_numpy(np.int64), hot["term"].to_numpy(float)
        tree.known = bit_map(tree.terms)
    return tree, counts


def score(df: DataFrame, tree: Tree, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of df.

    Null and empty texts are an end token alone. Repeated rows are scored one by one; an empty table gives no rows.
    """
    length, log_total = tree.depth + 1, tree.log_total
    buckets = buckets_for(tree.tokens)
    shared = df.sparkSession.sparkContext.broadcast((tree.head, np.log10(tree.head_counts + 1.0), tree.hot, tree.hot_terms, tree.known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        words, log_count, hot, hot_terms, some_term = shared.value
        rows, waiting = [], 0
        for b in batches:
            at = 0
            for texts in portions(b["text"]):
                part = b.iloc[at: at + len(texts)]
                at += len(texts)
                hashes, doc = tokens_of(texts, known)
                word = find(words, hashes)
                head = word >= 0
                base, model = np.zeros(len(word)), np.zeros(len(word))
                base[head] = log_count[word[head]]
                asked = [(hashes[~head], doc[~head])]
                ends, keys = np.arange(len(word)), hashes
                for d in range(length if some_term is not None else 0):
                    if d:
                        inside = ends >= d
                        inside[inside] = doc[ends[inside] - d] == doc[ends[inside]]
                        ends, keys = ends[inside], keys[inside]
                        keys = mixed(hashes[ends - d], keys)
                    some = some_term.holds(keys)
                    place = find(hot, keys[some])
                    model[ends[some][place >= 0]] += hot_terms[place[place >= 0]]
                    if d:  # words that aren't frequent are asked for anyway
                        asked.append((keys[some][place < 0], doc[ends[some][place < 0]]))
                        ends, keys = ends[some], keys[some]  # a term's sequence has a term without its first word too, if that is two words or more
                        if not len(ends):
                            break
                n = len(texts)
                size = np.bincount(doc, minlength=n)
                low = np.bincount(doc, weights=base, minlength=n) - size * log_total
                ids = part["doc_id"].astype("Int64")
                own = {
                    "own": part["pos"].to_numpy(), "doc_id": ids.fillna(0).to_numpy(np.int64), "known": ids.notna().to_numpy(bool), "n_tokens": size,
                    "n_known": np.bincount(doc[head], minlength=n), "base": low, "model": low + np.bincount(doc, weights=model, minlength=n)}
                yield pd.DataFrame([{"bucket": int(bucket_of(own["own"] << 16, buckets)[0])} | {c: b"" for c in asks} | {c: x.tobytes() for c, x in own.items()}])
                key, of = (np.concatenate(x) for x in zip(*asked))
                order = np.lexsort((key, of))
                key, of = key[order], of[order]
                fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])][: len(key)])
                rows.append((part["pos"].to_numpy()[of[fresh]], key[fresh], np.diff(np.r_[fresh, len(key)]).astype(np.int32)))
                waiting += len(fresh)
                if waiting > 1 << 19:
                    yield pack(rows)
                    rows, waiting = [], 0
        if rows:
            yield pack(rows)

    asks, owns = ["pos", "key", "times"], {"own": np.int64, "doc_id": np.int64, "known": bool, "n_tokens": np.int64, "n_known": np.int64, "base": float, "model": float}

    def pack(rows: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        columns = dict(zip(asks, (np.concatenate(x) for x in zip(*rows))))
        return packed(columns["key"], buckets, columns).assign(**{c: b"" for c in owns})

    def look(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """For each text that asks in a bucket, the sums of what it finds there, and what it brings along itself."""
        pos, key, times = (unpacked(asked[c], np.int32 if c == "times" else np.int64) for c in asks)
        own = {c: unpacked(asked[c], kind) for c, kind in owns.items()}
        texts, of = np.unique(np.r_[own["own"], pos], return_inverse=True)
        mine, of = of[: len(own["own"])], of[len(own["own"]):]
        told = told.sort_values("key")
        is_word = told["word"].to_numpy(bool)
        found = []
        for some in (told[is_word], told[~is_word]):
            at = find(some["key"].to_numpy(np.int64), key)
            there = np.flatnonzero(at >= 0)
            found.append((there, some["term"].to_numpy(float)[at[there]]))
        (words, log_n), (sequences, term) = found
        sums = {c: np.zeros(len(texts), owns[c]) for c in ("n_tokens", "n_known", "base", "model")}
        for c, x in sums.items():
            x[mine] = own[c]
        sums["n_known"] += np.bincount(of[words], times[words], len(texts)).astype(np.int64)
        base = np.bincount(of[words], times[words] * log_n, len(texts))
        sums["base"] += base
        sums["model"] += base + np.bincount(of[sequences], times[sequences] * term, len(texts))
        ids = pd.array([pd.NA] * len(texts), "Int64")
        ids[mine[own["known"]]] = own["doc_id"][own["known"]]
        return pd.DataFrame({"pos": texts, "doc_id": ids} | sums)

    pos = F.monotonically_increasing_id()
    slim = df.select(pos.alias("pos"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = slim.mapInPandas(run, ", ".join(["bucket int", *(f"{c} binary" for c in [*asks, *owns])]))
    told = counts.select(F.col("word").alias("key"), F.lit(True).alias("word"), F.log10(F.col("n") + 1).alias("term"))
    if tree.terms is not None:
        told = told.union(tree.terms.select("key", F.lit(False), "term"))
    found = rows.groupBy("bucket").cogroup(told.groupBy(bucket_column("key", buckets).alias("bucket"))).applyInPandas(
        look, "pos long, doc_id long, n_tokens long, n_known long, base double, model double")
    return found.groupBy("pos").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("model").alias("score")).drop("pos")


def op8_score(spark, folder: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, folder)
    held_out = remainder("doc_id", 7) == 2
    tree, counts = fit(docs.where(~held_out))
    for table in (t for level in tree.tables for t in level):  # terms hold all that is scored with
        forget(table)
    scored = score(docs, tree, counts)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
                         F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")
