"""Periodic runs of words, by a dictionary of basic factors.

Every factor of a power-of-two length gets a number that equal factors of one document share: a factor of twice the length is
the pair of its halves' numbers. A factor whose next occurrence lies at most its own length behind it (both within twice that
length) has that distance as a period, and neighbouring places of one distance are an arithmetic progression that proposes a
run. Proposals are extended word by word and kept once. A run of smallest period q is proposed by the factors of the least
power of two from q on: there the distance is q at every place, as a shorter one would be a smaller period. Only factors that
occur again in their document go on to the next length.

A null text has no words, so no run, as has an empty one. A document is handled whole, however long (some hundred bytes for each
word in memory), and documents are worked on many at a time. Repeated rows are judged one by one and come out as often, an empty
table gives an empty result, and columns other than doc_id and text are ignored. Of runs with equal exponents the first start,
then the smallest period, is the strongest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formlake.llm.kernels import sliced, texts_of

#: Words of a run, and its length in periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def _named(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places in order and their factors' keys: places of factors that occur again, numbers of these; places with a next occurrence, and its distance."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(np.concatenate([[0], ~same])) if len(key) else 0
    left, right = at[order[:-1][same]], at[order[1:][same]]
    back = np.argsort(left)
    return at[again], number[again], left[back], (right - left)[back]


def _extended(words: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [start, stop) grown word by word within [begin, end) as long as the period holds."""
    start, stop = start.copy(), stop.copy()
    for step, edge in ((-1, start), (1, stop)):
        open_ = np.arange(len(edge))
        while len(open_):
            new = edge[open_] - 1 if step < 0 else edge[open_]
            ok = (new >= begin[open_]) & (new < end[open_])
            open_, new = open_[ok], new[ok]
            ok = words[new] == words[new - step * period[open_]]
            open_ = open_[ok]
            edge[open_] += step
    return start, stop


def runs_of(words: np.ndarray, counts: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """The runs of documents whose words, as numbers, stand one document after another (counts: words of each): rows of document, start within it, length, period, in order."""
    n, ends = len(words), np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = ends[doc]
    found = [np.zeros((0, 3), np.int64)]
    at, size = np.arange(n), 1
    key = doc * (int(words.max()) + 1 if n else 1) + words
    longest = int(counts.max()) if len(counts) else 0
    while len(at) and size < 2 * max(1, longest // least_periods):
        at, number, place, distance = _named(key, at)
        ok = (distance <= size) & (2 * distance > size)
        place, distance = place[ok], distance[ok]
        if len(place):
            # Neighbouring places of one distance.
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1] + 1) | (distance[1:] != distance[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            start, period = place[first], distance[first]
            own = doc[start]
            start, stop = _extended(words, (ends - counts)[own], ends[own], start, place[last] + period + size, period)
            long = stop - start >= np.maximum(least_words, least_periods * period)
            found.append(np.stack([start, stop - start, period], axis=1)[long])
        # Factors of twice the length: both halves occur again, and the whole lies in the document.
        full = np.full(n, -1, np.int64)
        full[at] = number
        inside = at + 2 * size <= end[at]
        at, number = at[inside], number[inside]
        other = full[at + size]
        at, key = at[other >= 0], number[other >= 0] * (n + 1) + other[other >= 0]
        size *= 2
    out = np.unique(np.concatenate(found), axis=0)
    of = doc[out[:, 0]] if len(out) else np.zeros(0, np.int64)
    return np.column_stack([of, out[:, 0] - (ends - counts)[of], out[:, 1:]])


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[bytes]], list[np.ndarray]]]:
    """Ids, words and runs (start, length, period) of some documents at a time."""
    for batch in sliced(batches):
        words = [t.split() for t in texts_of(batch.column("text"))]
        flat = list(chain.from_iterable(words))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        runs = runs_of(np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), np.array([len(w) for w in words], np.int64))
        yield batch.column("doc_id"), words, np.split(runs[:, 1:], np.searchsorted(runs[:, 0], np.arange(1, len(words))))


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: a row for each run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, runs in _documents(batches):
            of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *(pa.array(flat[:, k]) for k in range(3))], ["doc_id", "start", "length", "period"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: every document without the repetitions of its runs, words joined by one blank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _documents(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([_kept(w, r).decode() for w, r in zip(words, runs, strict=True)], pa.string())], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli (nulls without a run), runs_sha256 of all runs and collapsed_sha256 of the words kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _documents(batches):
            rows = []
            for w, r in zip(words, runs, strict=True):
                top = min(r.tolist(), key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
                told = "".join(f"{s},{n},{p}\n" for s, n, p in r.tolist()) if top else ""
                best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                rows.append((len(r), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(_kept(w, r)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns))], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {'long' if k < 5 else 'string'}" for k, c in enumerate(NAMES)))


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
