"""Stretches of text that byte-level BPE encodes alike wherever they stand (units), found in whole batches of bytes.

The pattern that splits a text before the merges (`token_codec.PATTERN`) begins a new word at white space between two other
characters, and wherever one of the ASCII letters, digits and marks meets another kind of these; apostrophes, which begin
contractions, are left out. A text is cut there, so no word goes over a border and a unit's words are the same alone and within its
text. Where a neighbour may be white space beyond ASCII nothing is cut. A text with a special string of the tokenizer is one unit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from formlake.llm.kernels import mix, powers

#: Bytes of text worked on at once: the more, the fewer units are looked up again.
BATCH_BYTES = 4 << 20
#: Bytes of a unit that is remembered, at most.
UNIT_BYTES = 256

_LETTER, _DIGIT, _MARK, _WHITE, _APOSTROPHE, _LEAD = 1, 2, 3, 4, 5, 6
#: The kind of each byte; 0: may belong to white space, or not known.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[*range(9, 14), 32]] = _WHITE
_KIND[39] = _APOSTROPHE
# First bytes of characters that are never white space: those of other than U+0080 to U+00BF and U+1000 to U+3FFF.
_KIND[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = _LEAD
#: By the kinds of two neighbours: whether the second always begins a word; and whether white space may be cut off behind or before a kind.
_MEETS = np.array([[a != b and 0 < a < _WHITE and 0 < b < _WHITE for b in range(8)] for a in range(8)]).reshape(-1)
_BEHIND, _BEFORE = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _APOSTROPHE]), np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _APOSTROPHE, _LEAD])


def units(column: pa.Array, special: Sequence[bytes] = ()) -> tuple[pa.Array, np.ndarray]:
    """The units of some texts (a null is an empty one) one after another, and the number of the first of each text (one more for the end)."""
    texts = pc.fill_null(column.cast(pa.string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size, data = int(at[-1] - at[0]), texts.buffers()[2]
    if not size:
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    data = data.slice(int(at[0]), size)
    at = at - at[0]
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    # Second bytes of the letters U+00C0 to U+00FF.
    kind[1:][(raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)] = _LETTER
    cut = np.zeros(size, bool)
    cut[1:] = _MEETS[kind[:-1] << 3 | kind[1:]]
    white = np.flatnonzero(kind == _WHITE)
    white = white[(white > 0) & (white < size - 1)]
    cut[white[_BEHIND[kind[white - 1]] & _BEFORE[kind[white + 1]]]] = True
    whole = memoryview(data)
    for s in special:
        found = (text := bytes(whole)).find(s)
        while found >= 0:
            k = int(np.searchsorted(at, found, "right")) - 1
            cut[at[k] : at[k + 1]] = False
            found = text.find(s, int(at[k + 1]))
    cut[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), data]), np.searchsorted(starts, at)


def runs(joined: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary column one after another, and where each value begins in them (one more for the end)."""
    at = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64) if len(joined) else np.zeros(1, np.int64)
    return memoryview(joined.buffers()[2] or b"")[int(at[0]) : int(at[-1])], at - at[0]


class UnitMemory:
    """What units become: some binary columns with a value for each. `learn` makes them from new units; short units are remembered up to a number of bytes, then all are forgotten."""

    def __init__(self, learn: Callable[[pa.Array], list[pa.Array]], columns: int, special: Sequence[bytes], limit: int):
        self.learn, self.columns, self.special, self.limit = learn, columns, special, limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.known = pa.array([], pa.binary()), [pa.array([], pa.binary())] * self.columns

    def held(self) -> int:
        return sum(c.nbytes for c in (self.keys, *self.known))

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where each unit is among the known ones, -1 for new ones."""
        return pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def added(self, keys: pa.Array) -> None:
        """Told of units that are remembered from now on."""

    def find(self, column: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        """Each column's values for all units of some texts one after another, and the number of the first unit of each text (one more for the end)."""
        if self.held() > self.limit:
            self.forget()
        found, first = units(column, self.special)
        named = found.dictionary_encode()
        distinct, known = named.dictionary, self.known
        place = self.places(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            # New units follow the known ones; those that are too long to remember come last.
            long = pc.binary_length(distinct).to_numpy(zero_copy_only=False)[new] > UNIT_BYTES
            new = np.concatenate([new[~long], new[long]])
            place[new] = len(self.keys) + np.arange(len(new))
            keys, short = distinct.take(pa.array(new)), len(new) - int(long.sum())
            got = self.learn(keys)
            known = [pa.concat_arrays([a, b]) for a, b in zip(self.known, got, strict=True)]
            self.known = known if short == len(new) else [pa.concat_arrays([a, b[:short]]) for a, b in zip(self.known, got, strict=True)]
            self.keys = pa.concat_arrays([self.keys, keys[:short]])
            self.added(keys[:short])
        places = pa.array(place[named.indices.to_numpy()] if len(place) else place)
        return [c.take(places) for c in known], first


class IndexedMemory(UnitMemory):
    """A memory whose known units are found by an open-addressed table of their hashes, which grows with them and is not made anew for each batch. Units are equal only if their bytes are."""

    def forget(self) -> None:
        super().forget()
        self.hashes, self.slots = np.zeros(0, np.uint64), np.full(1 << 12, -1, np.int32)

    def held(self) -> int:
        return super().held() + self.hashes.nbytes + self.slots.nbytes

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def places(self, distinct: pa.Array) -> np.ndarray:
        h = hashed(distinct)
        out = np.full(len(h), -1, np.int64)
        open_, at = (np.arange(len(h)), self._slot(h)) if len(self.hashes) else (np.zeros(0, np.int64),) * 2
        while len(open_):
            got = self.slots[at]
            same = (got >= 0) & (self.hashes[got] == h[open_])
            out[open_[same]] = got[same]
            more = (got >= 0) & ~same
            open_, at = open_[more], (at[more] + 1) & (len(self.slots) - 1)
        known = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[known])), distinct.take(pa.array(known))).to_numpy(zero_copy_only=False)
        out[known[~same]] = -1
        return out

    def added(self, keys: pa.Array) -> None:
        todo = np.arange(len(self.hashes), len(self.hashes) + len(keys))
        self.hashes = np.concatenate([self.hashes, hashed(keys)])
        if 5 * len(self.hashes) > 3 * len(self.slots):
            todo, self.slots = np.arange(len(self.hashes)), np.full(1 << (2 * len(self.hashes)).bit_length(), -1, np.int32)
        at = self._slot(self.hashes[todo])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)


def hashed(column: pa.Array) -> np.ndarray:
    """64 bits of each value of a binary column."""
    raw, at = runs(column)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=total[1:])
    own = (total[at[1:]] - total[at[:-1]]) * powers(len(raw) + 1, inverse=True)[at[:-1]]
    return mix(own + np.diff(at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined(starts: np.ndarray, data: bytes | memoryview) -> pa.Array:
    """A binary column from where its values begin in some bytes (one more for the end)."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])


def stand_apart(column: pa.Array) -> np.ndarray:
    """Which units begin with white space and another character, and end with a letter, digit or mark of ASCII or a letter up to U+00FF: one after another in one text they stay units."""
    raw, at = runs(column)
    raw = np.frombuffer(raw, np.uint8)
    if not len(raw):
        return np.zeros(len(column), bool)
    last, many = at[1:] - 1, np.diff(at)
    second, end, before = raw[np.minimum(at[:-1] + 1, len(raw) - 1)], raw[last], raw[np.maximum(last - 1, 0)]
    closed = _BEHIND[_KIND[end]] | ((before == 0xC3) & (end != 0x97) & (end != 0xB7))
    return (many > 1) & (_KIND[raw[np.minimum(at[:-1], len(raw) - 1)]] == _WHITE) & _BEFORE[_KIND[second]] & closed
