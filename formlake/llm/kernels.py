"""Whole-batch word tables: byte work on many texts at once, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes between words: blank and 0x09 to 0x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes of text worked on at once (one text may be longer): the tables below stay in the CPU's caches.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `limit` bytes of a column (one row may be longer), cut before any row becomes a Python object."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        total = np.cumsum(sizes)
        at = 0
        while at < len(total):
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit)) + 1
            yield batch.slice(at, to - at)
            at = to


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_id, text) of batches in runs of about `limit` bytes."""
    for batch in sliced(batches, limit=limit):
        yield batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64, or of its inverse."""
    name = "inverse" if inverse else "base"
    if name not in _powers or len(_powers[name]) < n:
        step = np.full(max(n, CHUNK_BYTES + 4096), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        step[0] = 1
        _powers[name] = np.multiply.accumulate(step)
    return _powers[name][:n]


class WordTable:
    """The words of some texts. starts, ends: bytes in data; first[i]: number of the first word of text i; hashes: 64 bits of each word."""

    def __init__(self, texts: list[bytes], lower: bool = False, separator: np.ndarray = IS_SPACE, hashed: bool = True):
        joined = b" ".join(texts) + b" "
        self.raw = joined
        self.data = np.frombuffer(joined, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.offsets = at
        gap = separator[self.data]
        gap[at[1:] - 1] = True
        self.gap = gap
        step = np.diff(gap.view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
        own = (total[self.ends] - total[self.starts]) * powers(n, inverse=True)[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one blank after each, and where each begins in that (one more for the end)."""
        keep = ~self.gap
        keep[self.ends] = True
        out = self.data[keep]
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts + 1, out=at[1:])
        out[at[1:] - 1] = 32
        return out.tobytes(), at

    def doc_of(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words of one text and the first word's number of each. short: a text of fewer words but at least one counts as one run."""
        n = len(self.starts)
        doc = self.doc_of()
        whole = np.zeros(0, np.int64)
        h = np.zeros(0, np.uint64)
        if n >= k:
            h = mix(self.hashes[: n - k + 1])
            for j in range(1, k):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + self.hashes[j : n - k + 1 + j])
            whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            h = h[whole]
        if short and (few := np.flatnonzero((self.counts > 0) & (self.counts < k))).size:
            more = []
            for i in few:
                x = mix(self.hashes[self.first[i] : self.first[i] + 1])
                for j in range(self.first[i] + 1, self.first[i + 1]):
                    x = mix(x * np.uint64(0x9FB21C651E98DF25) + self.hashes[j : j + 1])
                more.append(x[0])
            whole, h = np.concatenate([whole, self.first[few]]), np.concatenate([h, np.array(more, np.uint64)])
            order = np.argsort(whole, kind="stable")
            whole, h = whole[order], h[order]
        return h, whole
