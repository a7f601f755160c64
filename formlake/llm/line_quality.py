"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its neighbours. A document's score is the mean of its
lines' marginal probabilities of being good, found by the forward-backward algorithm and weighted by the lines' lengths.
Labels are given to documents only, so the lines' labels are latent: a document's label is seen as a report on each of its
lines that is right with probability RELIABLE, and the fit climbs the likelihood of these reports. So a bad document may have
good lines and the chain learns both kinds of moves. The weights are fitted on the driver to a bounded sample of labelled
documents (at most `sample` documents and SAMPLE_LINES lines in all, chosen by a hash of doc_id; of these the lines' own
features are gathered, never texts, and always all lines of a document).

Null and empty texts have one empty line and a score like any other. Very long texts are scored whole, line by line; one of
more than SAMPLE_LINES lines is not learnt from. Repeated rows get equal scores. A score of exactly 0.5 counts as good. Without
labelled rows every score is 0.5. Labels that are null are not learnt from; a document labelled twice is learnt from once, by
its larger label. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.durable import checkpointed
from formlake.llm.kernels import IS_SPACE, chunks, mix, sliced, texts_of

#: Labelled documents that the model is fitted to, and their lines, at most.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 4000, 200_000
#: How often a document's label is right about one of its lines.
RELIABLE = 0.75
#: Penalties: of a line's own features, and of what it takes from its neighbours, so that these speak only where its own features leave it open.
RIDGE, RIDGE_NEAR = 1e-4, 0.1
ROUNDS, RATE = 150, 0.3

_CLASSES = {name: i for i, name in enumerate(("upper", "lower", "digit", "space", "symbol", "mark", "stop", "other", "wide", "tail"))}
_CLASS = np.full(256, _CLASSES["other"], np.int64)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\n\x0b\x0c\r"), ("symbol", b"#*$%&|<>~^_=+\\@{}[]"), ("mark", b"!?"), ("stop", b".,;:"), ("wide", range(192, 256)), ("tail", range(128, 192))):
    _CLASS[list(_bytes)] = _CLASSES[_name]


@dataclass
class Lines:
    """Features of the lines of some texts; first[i]: the first line of text i; sizes: characters of each line."""

    first: np.ndarray
    sizes: np.ndarray
    features: np.ndarray


def _distinct_ratio(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Of the keys of each owner: distinct ones among all, 1 for owners without keys."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    total = np.bincount(owner, minlength=n)
    return np.where(total > 0, np.bincount(o[new], minlength=n) / np.maximum(total, 1), 1.0)


def line_features(texts: list[bytes]) -> Lines:
    """Own features of every line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(n), ends - starts + 1)
    counts = np.bincount(owner * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, len(_CLASSES)).astype(np.float64)
    counts[:, _CLASSES["space"]] -= 1  # the line's own end
    of = lambda name: counts[:, _CLASSES[name]]
    sizes = counts.sum(axis=1) - of("tail")
    # Words of lines, by position: a hash of a word is a difference of prefix sums over mixed bytes.
    gap = IS_SPACE[data]
    step = np.diff(gap.view(np.int8), prepend=np.int8(1))
    w0, w1 = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    place = np.arange(len(data), dtype=np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)))])
    turn = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * place)])
    total = lambda a, b: mix((prefix[b] - prefix[a]) + np.uint64(3) * ((turn[b] - turn[a]) - a.astype(np.uint64) * (prefix[b] - prefix[a])))
    line_of = owner[w0]
    words = np.bincount(line_of, minlength=n)
    distinct = _distinct_ratio(line_of, total(w0, w1), n)
    # A line that equals an earlier one of its text.
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    keys = total(starts, ends)
    order = np.lexsort((np.arange(n), keys, doc))
    again = np.zeros(n)
    same = (doc[order][1:] == doc[order][:-1]) & (keys[order][1:] == keys[order][:-1]) & (words[order][1:] > 0)
    again[order[1:]] = same
    per = np.maximum(words, 1)
    letters = np.maximum(of("upper") + of("lower") + of("wide"), 1)
    own = np.stack(
        [
            np.log1p(sizes) / 5,
            np.minimum(sizes / per, 40) / 10,
            of("upper") / letters,
            np.minimum(of("digit") / np.maximum(sizes, 1), 1),
            np.minimum(of("symbol") / per, 4),
            np.minimum(of("mark") / per, 4),
            np.minimum(of("stop") / per, 4),
            np.minimum(of("other") / per, 4),
            1 - distinct,
            (1 - distinct) ** 3,
            again,
            (words == 0).astype(float),
        ],
        axis=1,
    )
    return Lines(first, sizes, own.astype(np.float32))


#: Own features of a line; of the model: those, the neighbours' means and a constant.
OWN = 12
N_FEATURES = 2 * OWN + 1


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of lines, the means of both neighbours' of the same text, and a constant."""
    n = len(own)
    joined = np.ones(max(n - 1, 0), bool)
    joined[first[1:-1] - 1] = False
    side, near = np.zeros((n, OWN), np.float64), np.zeros((n, 1))
    side[1:][joined] += own[:-1][joined]
    side[:-1][joined] += own[1:][joined]
    near[1:][joined] += 1
    near[:-1][joined] += 1
    return np.concatenate([own, side / np.maximum(near, 1), np.ones((n, 1))], axis=1)


def _forward_backward(unary: np.ndarray, first: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good of every line, expected numbers of moves (2 x 2), and the log partition of every text. unary: log-odds of good; weight: of each line's move from the one before. All texts take a step at once, the longest last."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, longest = first[:-1][order], int(sizes.max(initial=0))
    live = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")  # texts with at least t lines
    score = np.stack([np.zeros_like(unary), unary], axis=1)
    ahead = np.zeros_like(score)
    for t in range(longest):
        at = begin[: live[t]] + t
        ahead[at] = score[at] if t == 0 else score[at] + np.logaddexp(ahead[at - 1, 0, None] + move[0], ahead[at - 1, 1, None] + move[1])
    behind = np.zeros_like(score)
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = score[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
    last = first[1:] - 1
    whole = np.logaddexp(ahead[last, 0], ahead[last, 1])
    each = np.repeat(whole, sizes)
    good = np.exp(np.minimum(ahead[:, 1] + behind[:, 1] - each, 0))
    moves = np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    for a in range(2):
        for b in range(2):
            p = np.exp(ahead[at - 1, a] + move[a, b] + score[at, b] + behind[at, b] - each[at])
            moves[a, b] = p.sum() if weight is None else p @ weight[at]
    return good, moves, whole


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the log-odds and moves between labels, by gradient ascent (Adam) on the likelihood of the texts' labels as reports on their lines. labels: of texts."""
    x = with_neighbours(features, first)
    sizes = np.diff(first)
    # Every text counts alike, however many lines it has.
    weight = np.repeat(1 / np.maximum(sizes, 1), sizes)
    report = np.repeat(np.where(labels == 1, 1.0, -1.0), sizes) * np.log(RELIABLE / (1 - RELIABLE))
    theta = np.zeros(x.shape[1] + 4)
    ridge = np.full(len(theta), RIDGE)
    ridge[OWN : 2 * OWN] = ridge[-4:] = RIDGE_NEAR
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        move, unary = theta[-4:].reshape(2, 2), x @ theta[:-4]
        # What the features expect alone, and what they and the reports do.
        good, moves, _ = _forward_backward(unary, first, move, weight)
        told, told_moves, _ = _forward_backward(unary + report, first, move, weight)
        grad = np.concatenate([x.T @ (weight * (told - good)), (told_moves - moves).ravel()]) / len(sizes) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def line_marginals(texts: list[bytes], weights: np.ndarray, move: np.ndarray) -> tuple[Lines, np.ndarray]:
    lines = line_features(texts)
    good, _, _ = _forward_backward(with_neighbours(lines.features, lines.first) @ weights, lines.first, move)
    return lines, good


def scores(texts: list[bytes], weights: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Mean marginal of each text's lines, weighted by their lengths."""
    lines, good = line_marginals(texts, weights, move)
    weight = lines.sizes + 1
    return np.clip(np.add.reduceat(good * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1]), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted to at most `sample` of the labelled documents, chosen by a hash of doc_id. labels: doc_id, label (0 or 1)."""
    chosen = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` pairs of numbers, so they can go to every task.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lines = line_features(texts_of(batch.column("text")))
            sizes = np.diff(lines.first)
            some = np.flatnonzero(sizes <= SAMPLE_LINES)
            own = [lines.features[lines.first[i] : lines.first[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), batch.column("label").take(pa.array(some)), pa.array(sizes[some]), pa.array(own, pa.binary())], ["doc_id", "label", "lines", "features"])

    rows = checkpointed(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id long, label int, lines long, features binary"))
    # At most `sample` pairs of numbers say how many of the documents are within the bound of lines; only their features come to the driver.
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("features"))
    sizes = rows.select("lines").orderBy(*order).toArrow().column("lines").to_numpy()
    n = int(np.searchsorted(np.cumsum(sizes), SAMPLE_LINES, "right"))
    rows = rows.orderBy(*order).limit(n).select("label", "features").collect()
    if not rows:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    each = [np.frombuffer(r.features, np.float32).reshape(-1, OWN) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return fit(np.concatenate(each), first, np.array([r.label for r in rows]))


def score(docs: DataFrame, weights: np.ndarray, move: np.ndarray) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores(texts, weights, move))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def line_scores(docs: DataFrame, weights: np.ndarray, move: np.ndarray) -> DataFrame:
    """doc_id, line (from 0), n_chars and score (marginal probability of being good) of every line: what a document's score is made of."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            lines, good = line_marginals(texts, weights, move)
            sizes = np.diff(lines.first)
            number = np.arange(len(good)) - np.repeat(lines.first[:-1], sizes)
            columns = [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes))), pa.array(number), pa.array(lines.sizes.astype(np.int64)), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "n_chars", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line long, n_chars long, score double")
