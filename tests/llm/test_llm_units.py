"""Units of text: the pattern's words within them are those of the whole text, and each is encoded once."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from tokenizers import Tokenizer

from formlake.llm import token_codec, token_output
from formlake.llm.units import UNIT_BYTES, IndexedMemory, UnitMemory, runs, units

SPECIAL = "<|endoftext|>"
PARTS = ["a", "B", "st", "é", "ß", "ł", "А", "漢", "ⅷ", "1", "2", "²", "'", "'s", "'ll", " ", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", "—", "×", "÷", "!", "($", "_-", ".", "😀", "́", SPECIAL]


def made(seed, n):
    r = random.Random(seed)
    return [None, "", *("".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n))]


def spread():
    """Lines of 300 words with each of ten marks behind them."""
    r = random.Random(8)
    words = ["".join(r.choice("aeinorst") for _ in range(9)) for _ in range(300)]
    return words, ["\n".join(f"{w}{m} {w}" for w in words) for m in ".,;:!?%*#&"]


@pytest.fixture(scope="module")
def blob():
    with open(token_codec.default_path(), "rb") as f:
        return f.read()


def test_units_hold_the_words_of_the_pattern():
    split, texts = regex.compile(token_codec.PATTERN).findall, made(1, 20_000)
    column = pa.array(["before", *texts, "after"], pa.string())[1:-1]
    found, first = units(column, [SPECIAL.encode()])
    known = found.to_pylist()
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        own = [u.decode() for u in known[a:b]]
        assert "".join(own) == (t or "") and (len(own) == 1 if SPECIAL in (t or "") else [w for u in own for w in split(u)] == split(t or ""))
    assert len(units(pa.array([], pa.string()))[0]) == 0 and units(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


def test_memory_forgets_and_leaves_out_long_units():
    asked = []

    def learn(new):
        asked.extend(new.to_pylist())
        return [pa.array([x.upper() for x in new.to_pylist()], pa.binary())]

    texts = pa.array(["one two\nthree", "x" * (UNIT_BYTES + 1) + " two", None, "three one"])
    memory = UnitMemory(learn, 1, [], 1 << 20)
    for _ in range(2):
        (got,), first = memory.find(texts)
        assert bytes(runs(got)[0]).decode() == "".join(t.upper() for t in texts.to_pylist() if t) and first.tolist() == [0, 3, 5, 5, 7]
    assert sorted(asked, key=len) == [b"one", b" two", b" one", b"three", b"\nthree", *[b"x" * (UNIT_BYTES + 1)] * 2]
    memory.limit = 0
    assert bytes(runs(memory.find(texts[3:])[0][0])[0]) == b"THREE ONE" and len(memory.keys) == 2


def test_library_ids_encode_each_word_once(blob):
    library, sent = token_output.LibraryIds(blob), []
    own = library.library

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return own.encode_batch_fast(texts, **kw)

    library.library = Counted()
    words, texts = spread()
    for some in (texts, made(2, 5000)):
        ids, sizes = library.ids(pa.array(some, pa.string()))
        expected = [[*e.ids, 2] for e in own.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, expected)) and (ids == np.concatenate(expected)).all()
        if some is texts:
            # Each word stands behind nothing, behind a line's end and behind a blank; its marks make no other units of it.
            assert sum(map(len, sent)) < 2 * sum(len(w) + 1 for w in words) + 100


def test_codec_learns_each_word_once(blob):
    codec = token_codec.Codec(token_codec.Vocabulary(blob), token_codec.Transducer.build({}))
    words, texts = spread()
    library = Tokenizer.from_file(token_codec.default_path())
    for some in (texts, made(3, 5000)):
        (data, at), (decimals, ends), (decoded, _) = codec.encode(pa.array(some, pa.string()))
        expected = [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert np.diff(at).tolist() == [4 * len(x) for x in expected] and np.frombuffer(data, "<u4").tolist() == [i for x in expected for i in x]
        assert [bytes(decimals[a:b]).decode() for a, b in zip(ends, ends[1:], strict=False)] == ["".join(f"{i}," for i in x) for x in expected]
        assert bytes(decoded).decode() == "".join(t or "" for t in some)
        if some is texts:
            assert len(codec.memory.keys) <= 2 * len(words) + 11


def test_indexed_memory_equals_plain_one():
    def learn(new):
        return [pa.array([x[::-1] for x in new.to_pylist()], pa.binary())]

    plain, indexed = UnitMemory(learn, 1, [], 1 << 20), IndexedMemory(learn, 1, [], 1 << 20)
    r = random.Random(5)
    for k in range(12):
        if k == 8:
            plain.limit = indexed.limit = 0
        texts = pa.array([None, "", *(" ".join(str(r.randrange(400 << k)) for _ in range(2000)) for _ in range(3)), "y" * (UNIT_BYTES + 1 + k)])
        (a,), x = plain.find(texts)
        (b,), y = indexed.find(texts)
        assert a.equals(b) and (x == y).all() and plain.keys.equals(indexed.keys) and len(indexed.hashes) == len(indexed.keys)


def test_indexed_memory_tells_units_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr("formlake.llm.units.hashed", lambda column: np.full(len(column), 7, np.uint64))
    memory = IndexedMemory(lambda new: [pa.array([x.upper() for x in new.to_pylist()], pa.binary())], 1, [], 1 << 20)
    for _ in range(3):
        assert bytes(runs(memory.find(pa.array(["one two three", "three two"]))[0][0])[0]) == b"ONE TWO THREETHREE TWO"


def test_library_ids_look_up_no_more_than_a_batch(blob, monkeypatch):
    """A table of all known units for each batch took more time the more a worker knew."""
    library = token_output.LibraryIds(blob)
    library.ids(pa.array([" ".join(f"w{i}" for i in range(20_000))]))
    monkeypatch.setattr(pc, "index_in", lambda *a, **b: pytest.fail("a table of all known units was made"))
    seen = []
    monkeypatch.setattr(library.memory, "_slot", lambda h: (seen.append(len(h)), IndexedMemory._slot(library.memory, h))[1])
    library.ids(pa.array(["w1 w2 w3 new"]))
    assert 0 < max(seen) < 20
