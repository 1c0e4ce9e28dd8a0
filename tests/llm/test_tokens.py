"""BPE: equal to the tokenizers library, whatever the portions; packing holds every id once."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from colscope.llm import packing, tokens
from colscope.llm.bpe import Decoder, Transducer, decode_text, lookahead, merge
from colscope.llm.packing import first_fit_decreasing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.WORD_BPE)


def same(library, text):
    return np.frombuffer(tokens.encoder(tokens.WORD_BPE).encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["a", "ab", "the ", "é漢a", "'tsve ", "<|endoftext|>", "aé Σ\x1c\x85"])
def test_like_the_library(library, letters):
    rng = random.Random(1)
    for n in (1, 7, 300, 5000):
        assert same(library, "".join(rng.choice(letters) for _ in range(n)))


def test_letters_newer_than_python(library):
    new = [c for c in map(chr, range(0x40000)) if unicodedata.category(c) == "Cn"]
    texts = [f"a{c}b1{c}'s" for c in new] + ["".join(new[i: i + 7]) + "\u0301 x" for i in range(0, len(new), 7)]
    tool = tokens.encoder(tokens.WORD_BPE)
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want) if np.frombuffer(tool.encode(t), np.uint32).tolist() != w.ids]
    assert not wrong
    assert {"\u1c89", "\U00010d50", "\ua7cb", "\U0001e5d0"} <= set(new)


def test_transducer_in_portions():
    v = tokens.encoder(tokens.WORD_BPE).v
    rng = random.Random(2)
    word = "".join(rng.choice("thean") for _ in range(6000)).encode()
    whole = merge([v.inner[b] for b in word[:-1]] + [v.final[word[-1]]], v.ranks)
    for step in (1, 50, 7000):
        t = Transducer(v)
        out, most = [], 0
        for at in range(0, len(word), step):
            out += t.feed(word[at: at + step])
            most = max(most, len(t.held))
        assert out + list(t.finish()) == whole
        assert most <= t.window


def test_lookahead_follows_chains():
    assert lookahead([("a", "b")]) == 1
    assert lookahead([("b", "c"), ("a", "bc")]) == 2
    assert lookahead([("b", "c"), ("a", "d")]) == 1


def test_decoder(library):
    text = "Hello wörld 漢字 it's 12"
    ids = library.encode(text, add_special_tokens=False).ids
    v = tokens.encoder(tokens.WORD_BPE).v
    assert "".join(decode_text(Decoder(v, "tokens"), [[i] for i in ids])) == library.decode(ids, skip_special_tokens=False)
    assert "".join(decode_text(Decoder(v, "text"), [[i] for i in ids])) == "hello wörld 漢 字 it 's 1 2".replace("漢 字", "漢字")


def test_round_trip(odd, odd_rows, nothing, library):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.round_trip(odd).collect())
    want = []
    for i, text, *_ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert tokens.round_trip(nothing).count() == 0


def test_columns(odd):
    both = tokens.decode_ids(tokens.encode_texts(odd))
    assert both.columns == [*odd.columns, "ids", "decoded"]
    assert both.where("doc_id = 5").first().decoded == "a b c"
    with pytest.raises(ValueError):
        tokens.encode_texts(odd, ids_col="lang")


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    bins, offsets = first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):  # the plain version
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        assert bins[i] == at and offsets[i] == 100 - room[at]
        room[at] -= lengths[i]


def test_packing(odd, odd_rows, nothing, library):
    rows = packing.pack_documents(odd).collect()
    documents = {}
    for i, text, *_ in odd_rows:
        documents[i] = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    places, held = {}, {}
    for r in rows:
        part = documents[r.doc_id][r.start: r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(documents[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    copies = {i: sum(x[0] == i for x in odd_rows) for i in documents}
    assert held == {i: len(d) * copies[i] for i, d in documents.items()}
    assert packing.pack_documents(nothing).count() == 0
