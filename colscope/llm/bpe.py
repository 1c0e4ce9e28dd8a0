"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

A word (a run of letters, one digit, a run of other signs, or a contraction) is a sequence of byte symbols, the
last of which carries the end-of-word mark. Merges apply by rank, leftmost first. Let f(r) be the furthest a
difference to the right can travel left through rule r = (u, v):

    f(r) = |u| + max f(r') over earlier rules r' = (u', v') for which u' is a prefix of v

for it moves a boundary only where u ends at the present boundary, and the token right of it then begins with
what the last step moved. The largest f is the lookahead of the merge list: a token that ends so many symbols
before the end of what has been read is final, whatever follows. The transducer reads a window of a few times
that many symbols, emits what is final and goes on behind it, so its memory does not depend on the text.
Splitting there changes nothing, because no merge ever crossed a final boundary.

Signs that Python's tables (Unicode 15.1) don't know are put into lower case and told to be letters, digits or others by
the library's own tables, sign by sign, so that both know the same letters.

The argument needs a proper merge list (every part of a rule is a byte or made by an earlier rule); this is checked on loading.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from tokenizers import Regex, normalizers, pre_tokenizers

END = "</w>"
#: The file's pattern for words, and white space as its pattern knows it.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII without white space; letters up to here are in all versions of Unicode.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
LATIN_END = "\u0250"
BLANK = regex.compile(r"\s+")
#: Stand for a letter, a digit and another sign that Python's tables don't know; the letter is in no contraction.
NEW_LETTER, NEW_DIGIT, UNKNOWN = "\u0250", "\u0660", "\uffff"
#: Control signs that Python's split() takes for white space and the pattern doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: What a pair without a rule has: a rank behind all others.
NO_RULE = (1 << 40, -1)
#: Words that the cache holds at most in each of its two halves, and the longest word it takes.
CACHE_WORDS, CACHE_CHARS = 250_000, 64


def is_new(sign: str) -> bool:
    return not sign.isascii() and unicodedata.category(sign) == "Cn"


@lru_cache(maxsize=1 << 16)
def kind_of_new(sign: str) -> str:
    """The stand-in for a sign that is new to Python, by the library's tables."""
    for kind, stand_in in ((r"\p{L}", NEW_LETTER), (r"\p{N}", NEW_DIGIT)):
        if not pre_tokenizers.Split(Regex(kind), "removed").pre_tokenize_str(sign):
            return stand_in
    return UNKNOWN


@lru_cache(maxsize=1)
def library_form() -> normalizers.Normalizer:
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes: Latin-1 letters and signs for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Symbols, ranked merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE file with word ends is needed")
        ids, letters = model["vocab"], byte_alphabet()
        self.inner = [ids[letters[b]] for b in range(256)]
        self.final = [ids[letters[b] + END] for b in range(256)]
        self.rules = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(ids[u], ids[v]): (rank, ids[u + v]) for rank, (u, v) in enumerate(self.rules)}
        self.strings = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(self.strings) + 1
        self.letters = {c: b for b, c in letters.items()}
        self.length = {i: len(t.removesuffix(END)) for t, i in ids.items()}
        made: dict[str, int] = {}
        for rank, (u, v) in enumerate(self.rules):
            if any(len(x.removesuffix(END)) > 1 and x not in made for x in (u, v)) or u + v in made:
                raise ValueError(f"the merge list is not proper at {u} {v}")
            made[u + v] = rank
        self.lookahead = lookahead(self.rules)


def lookahead(rules: list[tuple[str, str]]) -> int:
    """Symbols by which a final token's end must lie before the end of what has been read."""
    reach: dict[str, int] = {}
    most = 0
    for u, v in rules:
        far = len(u) + max((reach[v[:i]] for i in range(1, len(v) + 1) if v[:i] in reach), default=0)
        reach[u] = max(reach.get(u, 0), far)
        most = max(most, far)
    return most


def merge(symbols: list[int], ranks: dict) -> list[int]:
    """Merges by rank, leftmost first. ranks: of a pair, its rank and the id of the merged symbol."""
    if len(symbols) > 300:
        return merge_long(symbols, ranks)
    out, get = list(symbols), ranks.get
    found = [get(pair, NO_RULE) for pair in zip(out, out[1:])]
    while found:
        best = min(found)
        if best is NO_RULE:
            break
        i = found.index(best)
        out[i] = best[1]
        del out[i + 1], found[i]
        if i:
            found[i - 1] = get((out[i - 1], out[i]), NO_RULE)
        if i < len(found):
            found[i] = get((out[i], out[i + 1]), NO_RULE)
    return out


def merge_long(symbols: list[int], ranks: dict) -> list[int]:
    """The same with a heap of (rank, place), for windows of hundreds of symbols."""
    out, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap = [(found[0], i, found[1], a, b) for i, (a, b) in enumerate(zip(out, out[1:])) if (found := ranks.get((a, b)))]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if out[i] != a or j >= len(out) or out[j] != b:
            continue
        out[i], out[j], after[i] = new, -1, after[j]
        if after[j] < len(out):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(out) and (found := ranks.get((out[left], out[right]))):
                heapq.heappush(heap, (found[0], left, found[1], out[left], out[right]))
    return [x for x in out if x >= 0]


class Transducer:
    """Reads one word's bytes in any portions and emits ids as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None):
        self.v = vocabulary
        self.window = max(window or 0, vocabulary.lookahead + max(vocabulary.length.values()) + 1)
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        step = self.window
        for at in range(0, len(data), step):
            self.held += data[at: at + step]
            while len(self.held) > self.window:  # the last byte waits: it may be the word's end
                ready = [self.v.inner[b] for b in self.held[:-1]]
                final, done = len(ready) - self.v.lookahead, 0
                for token in merge(ready, self.v.ranks):
                    if done + self.v.length[token] > final:
                        break
                    done += self.v.length[token]
                    yield token
                del self.held[:done]

    def finish(self) -> Iterator[int]:
        if self.held:
            yield from merge([self.v.inner[b] for b in self.held[:-1]] + [self.v.final[self.held[-1]]], self.v.ranks)
        self.held.clear()


class Chunks(dict):
    """Packed ids of chunks without white space, in two generations: what is in use survives, the rest is forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class Encoder:
    """Whole texts to packed ids (native unsigned 32-bit integers)."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.transducer = Transducer(self.v, window=4 * self.v.lookahead)
        self.chunks, self.words = Chunks(self.of_chunk), Chunks(self.of_word)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.v.special) + ")") if self.v.special else None

    def of_word(self, word: str) -> bytes:
        data = word.encode()
        if len(data) <= self.transducer.window:  # the end is in sight: everything is final at once
            symbols = [self.v.inner[b] for b in data]
            symbols[-1] = self.v.final[data[-1]]
            return array("I", merge(symbols, self.v.ranks)).tobytes()
        return array("I", [*self.transducer.feed(data), *self.transducer.finish()]).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isascii():
            return b"".join([words[w] for w in ASCII_WORD.findall(chunk)])
        if max(chunk) < LATIN_END:
            return b"".join([words[w] for w in WORD.findall(chunk)])
        if any(map(is_new, chunk)):
            chunk = library_form().normalize_str(chunk)
        known = "".join(kind_of_new(c) if is_new(c) else c for c in chunk)
        return b"".join([words[chunk[m.start(): m.end()]] for m in WORD.finditer(known)])

    def normal(self, text: str) -> str:
        """Composed and in lower case, letter by letter: a final sigma has no form of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def plain(self, text: str) -> bytes:
        text = self.normal(text)
        chunks = BLANK.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text; the strings of special tokens in it stand for those tokens; null and empty give none."""
        if not text:
            return b""
        if self.specials is None or "<|" not in text:
            return self.plain(text)
        return b"".join(array("I", [self.v.special[part]]).tobytes() if part in self.v.special else self.plain(part)
                        for part in self.specials.split(text))


class Decoder:
    """Bytes of the decoded text as ids come in.

    form "tokens": the token strings with one space between, as the library shows them for a file that names
    no decoder. form "text": the bytes that the tokens stand for, a space for each word end but the last, with
    unfinished and wrong UTF-8 replaced.
    """

    def __init__(self, vocabulary: Vocabulary, form: str = "tokens"):
        if form not in ("tokens", "text"):
            raise ValueError(form)
        self.form, self.begun = form, False
        blank = [b""] * vocabulary.size
        self.pieces, self.ends = list(blank), [False] * vocabulary.size
        special = set(vocabulary.special.values())
        for i, s in vocabulary.strings.items():
            self.ends[i] = s.endswith(END)
            self.pieces[i] = s.encode() if form == "tokens" or i in special else bytes(
                vocabulary.letters[c] for c in s.removesuffix(END))
        self.space = False

    def feed(self, ids: Iterable[int]) -> bytes:
        if self.form == "tokens":
            out = b" ".join(map(self.pieces.__getitem__, ids))
            out, self.begun = (b" " + out if self.begun and out else out), self.begun or bool(out)
            return out
        parts = []
        for i in ids:
            if self.space:
                parts.append(b" ")
            parts.append(self.pieces[i])
            self.space = self.ends[i]
        return b"".join(parts)

    def restart(self) -> None:
        self.begun = self.space = False


def decode_text(decoder: Decoder, portions: Iterable[Iterable[int]]) -> Iterator[str]:
    """Text of ids that come in portions: a state machine holds back the bytes of an unfinished character."""
    import codecs

    machine = codecs.getincrementaldecoder("utf-8")("replace")
    decoder.restart()
    for ids in portions:
        yield machine.decode(decoder.feed(ids))
    yield machine.decode(b"", final=True)
