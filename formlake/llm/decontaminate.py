"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words of the lower-cased text (A-Z only) make shingles of five; an item or window of fewer words is one shingle. A document
is contaminated by an item if a window of as many words as the item has a weighted Jaccard similarity of SIMILARITY or more
to it, weights being how often a shingle occurs; a document of fewer words than the item is one window of all its words, compared
with every longer item that it shares a shingle with. Window and item have equally many shingles, so the similarity needs a
share of 2 s / (1 + s) of the window's shingles to be in the benchmark: SimHash fingerprints are made of every item-sized window
that has it. The fingerprints' blocks are looked up in an index of the items of that size: with radius below
BLOCKS * (PROBE + 1), two fingerprints within the radius are within PROBE bits in some block, so every item within it is
found; the exact similarity of the words then decides. A pair of similarity 0.8 has 9.7 unlike bits on average (standard
deviation 2.9), so RADIUS lies 4.6 deviations above the farthest kind of match.

Null and empty texts and items match nothing. Very long texts are worked through in stretches. Repeated rows are judged alike,
those without a doc_id too. Items with equal text are reported each; of equally similar windows the first is. An empty
benchmark leaves every document clean. Other columns are ignored. Only a benchmark of at most
MAX_BENCHMARK_BYTES is gathered and sent to all tasks. A larger one stays a table: documents are joined with its parts by shingles, and read
as often as there are such parts for them, not once for each part.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.durable import checkpointed
from formlake.llm.kernels import WordTable, chunks, sliced

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, PROBE = 23, 8, 2
#: A larger benchmark is not sent to all tasks; then documents go to its parts, about so many bytes of them to a task.
MAX_BENCHMARK_BYTES, ROUTED_BYTES = 32 << 20, 256 << 20
_FILTER_BITS = 22
#: A column's name that no caller has.
FREE = "__leaked_text_key__"
#: Windows whose fingerprints are made at once, and bytes of a table of candidates.
_STRETCH, _TABLE = 1 << 14, 1 << 22
#: 1 where two bytes are within PROBE bits.
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= PROBE


class Items:
    """The benchmark's index, the same in every task."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        table = WordTable(texts, lower=True)
        h, at = table.grams(SHINGLE, short=True)
        owner = table.doc_of()[at]
        self.ids, self.texts = ids, texts
        self.words = table.counts
        self.sizes = sorted({int(n) for n in self.words if n})
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.only = {i: int(h[ends[i]]) for i in np.flatnonzero((self.words > 0) & (self.words < SHINGLE)).tolist()}
        self.prints = np.zeros(len(ids), np.uint64)
        for i in np.flatnonzero(self.words).tolist():
            self.prints[i] = simhash(h[ends[i] : ends[i + 1]])
        order = np.argsort(h, kind="stable")
        self.sorted, self.owners = h[order], owner[order]
        self.known = np.unique(h)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # Of each size: its items, and per block which of them a value is within PROBE bits of, for all 256 values.
        by_size = np.argsort(self.words, kind="stable")
        cut = np.searchsorted(self.words[by_size], self.sizes)
        self.index = {}
        for size, own in zip(self.sizes, np.split(by_size, cut)[1:], strict=True):
            values = [(self.prints[own] >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64) for b in range(BLOCKS)]
            self.index[size] = own, [np.packbits(_NEAR[:, v], axis=1) for v in values]
        self.shingles = cache(lambda i: _counted(self.texts[i].lower().split()))

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        may = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(self.known):
            return may[:0]
        place = np.minimum(np.searchsorted(self.known, h[may]), len(self.known) - 1)
        return may[self.known[place] == h[may]]

    def longer(self, h: np.ndarray, words: int) -> list[int]:
        """Items of more than so many words that have one of the shingles."""
        a, b = np.searchsorted(self.sorted, h, "left"), np.searchsorted(self.sorted, h, "right")
        found = np.unique(np.concatenate([self.owners[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)] or [np.zeros(0, np.int64)]))
        return found[self.words[found] > words].tolist()

    def lookup(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(fingerprint's number, item) of items of a size within RADIUS."""
        own, tables = self.index[size]
        step = max(1, _TABLE // len(own))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            found = np.zeros((len(some), tables[0].shape[1]), np.uint8)
            for b, table in enumerate(tables):
                found |= table[(some >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)]
            row, col = np.nonzero(np.unpackbits(found, axis=1, count=len(own)))
            ok = np.bitwise_count(some[row] ^ self.prints[own[col]]) <= RADIUS
            yield from zip((at + row[ok]).tolist(), own[col[ok]].tolist(), strict=True)


def simhash(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def _counted(words: list[bytes]) -> Counter:
    """Shingles of words; fewer words than a shingle has are one."""
    return Counter(zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else Counter([tuple(words)] if words else [])


def _similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def scan_text(text: bytes, words: int, h: np.ndarray, hit: np.ndarray, items: Items) -> dict[int, tuple[float, int]]:
    """Of one document: item -> (best similarity, first word of its first best window). h: its shingles in order; hit: places of shared ones."""
    own = cache(lambda: text.lower().split())
    best: dict[int, tuple[float, int]] = {}
    if words < SHINGLE:
        return {i: (1.0, 0) for i in (items.index[words][0].tolist() if words in items.index else ()) if items.shingles(i) == _counted(own())}
    for size in items.sizes:
        n = size - SHINGLE + 1
        if n < 1 or n > len(h):
            continue
        # The last place that leaves room for a window, and the least number of shared shingles in it.
        need = int(np.ceil(2 * n * SIMILARITY / (1 + SIMILARITY) - 1e-9))
        if len(hit) < need:
            continue
        # Windows begin at most so far before their first shared shingle as they have shingles to spare.
        begin = np.unique(np.maximum(hit[: len(hit) - need + 1][:, None] - np.arange(n - need + 1)[None, :], 0))
        begin = begin[begin <= len(h) - n]
        at = begin[np.searchsorted(hit, begin + n) - np.searchsorted(hit, begin) >= need]
        for k in range(0, len(at), _STRETCH):
            some = at[k : k + _STRETCH]
            prints = _window_prints(h, some, n)
            for x, i in items.lookup(prints, size):
                start = int(some[x])
                s = _similarity(items.shingles(i), _counted(own()[start : start + size]))
                if s >= SIMILARITY and s > best.get(i, (0.0, 0))[0]:
                    best[i] = (s, start)
    if words < items.sizes[-1] and (longer := items.longer(np.unique(h[hit]), words)):
        whole = _counted(own())
        for i in longer:
            s = _similarity(items.shingles(i), whole)
            if s >= SIMILARITY:
                best[i] = (s, 0)
    return best


def _window_prints(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """SimHashes of windows of n shingles, by differences of sums over each stretch that windows share."""
    out = np.zeros(len(at), np.uint64)
    cut = np.flatnonzero(np.diff(at) > n) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        low, high = int(at[a]), int(at[b - 1]) + n
        bits = np.unpackbits(h[low:high].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        count = sums[at[a:b] - low + n] - sums[at[a:b] - low]
        out[a:b] = np.packbits(2 * count > n, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


#: The index of a worker that is used again, by the digest of the benchmark.
_built: dict[str, Items] = {}


def _index(sent) -> Items:
    key, rows = sent.value
    if key not in _built:
        _built.clear()
        _built[key] = Items([i for i, _ in rows], [t.encode() for _, t in rows])
    return _built[key]


_FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _matches(batches: Iterable[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """The leaks of documents (doc_id, text), one batch for each stretch of texts."""
    for ids, texts in chunks(batches):
        table = WordTable(texts, lower=True)
        h, at = table.grams(SHINGLE, short=True)
        doc = table.doc_of()[at]
        hit = items.hits(h)
        out: list[tuple] = []
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        hits = np.searchsorted(doc[hit], np.arange(len(texts) + 1))
        for k in np.unique(doc[hit]).tolist():
            a, b = ends[k], ends[k + 1]
            words = int(table.counts[k])
            found = scan_text(texts[k], words, h[a:b], hit[hits[k] : hits[k + 1]] - a, items)
            out += [(ids[k], items.ids[i], s, start, min(words, int(items.words[i]))) for i, (s, start) in found.items()]
        if items.only:
            out += _short_items(ids, texts, table, items)
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])


def _scan(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    """Leaks of a benchmark of proven size: every task has its index."""
    sent = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(rows).encode()).hexdigest(), rows))
    return docs.mapInArrow(lambda batches: _matches(batches, _index(sent)), _FOUND)


def _keys(rows: DataFrame, short: list[int]) -> DataFrame:
    """doc_id, h: the distinct shingles of each row (doc_id, text), and the runs of as many words as short items have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            table = WordTable(texts, lower=True)
            found = [table.grams(SHINGLE, short=True), *(table.grams(n) for n in short)]
            h, doc = np.concatenate([x for x, _ in found]), np.concatenate([table.doc_of()[at] for _, at in found])
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            own = np.array(ids, np.int64)[doc[new]]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(h[new].view(np.int64))], ["doc_id", "h"])

    return rows.mapInArrow(run, "doc_id long, h long")


def _scan_parts(docs: DataFrame, items: DataFrame, parts: int) -> DataFrame:
    """Leaks of a benchmark too large to be sent: it stays a table in so many parts, and a document meets the parts that it shares a shingle with.

    Documents and items are joined by shingles, so documents are read once however many parts there are. Each part is then copied to as many tasks as
    its documents need (about ROUTED_BYTES each); a task has one part's index at a time and takes its documents as a stream.
    """
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    short = [r[0] for r in items.select(words.alias("n")).filter(F.col("n") < SHINGLE).distinct().collect()]
    known = _keys(items.select(F.col("part").cast("long").alias("doc_id"), "text"), []).select(F.col("doc_id").cast("int").alias("part"), "h").distinct()
    # Equal keys of unlike documents would only bring one of them to more parts.
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    routes = checkpointed(_keys(docs.select(F.col("key").alias("doc_id"), "text"), sorted(short)).join(known, "h").select(F.col("doc_id").alias("key"), "part").distinct())
    routed = docs.join(routes, "key")
    size = routes.join(docs.groupBy("key").agg(F.sum(F.octet_length("text")).alias("size")), "key").groupBy("part").agg(F.ceil(F.sum("size") / ROUTED_BYTES).cast("int").alias("tasks"))
    size = checkpointed(size.withColumn("tasks", F.greatest("tasks", F.lit(1))))
    tasks = size.agg(F.coalesce(F.sum("tasks"), F.lit(1))).first()[0]
    # Copies of a text have other numbers, so a text that holds a third of all rows is no hot key; a task that runs again deals alike.
    sent = routed.join(F.broadcast(size), "part").select("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), "doc_id", "text")
    own = items.join(F.broadcast(size), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), F.col("item_id").alias("doc_id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = None, None
        rows: list[tuple[int | None, str]] = []
        for batch in sliced(batches):
            part, task, kind = (batch.column(c).to_numpy() for c in ("part", "task", "kind"))
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
                piece, at = batch.slice(a, b - a), (int(part[a]), int(task[a]))
                if at != held:
                    held, items, rows = at, None, []
                if kind[a] == 0:
                    rows += zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True)
                    continue
                if items is None:
                    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
                    items = Items([i for i, _ in rows], [x.encode() for _, x in rows])
                yield from _matches([piece], items)

    together = sent.unionByName(own).repartition(max(1, tasks), "part", "task").sortWithinPartitions("part", "task", "kind")
    return together.mapInArrow(run, _FOUND)


def _short_items(ids: list, texts: list[bytes], table: WordTable, items: Items) -> list[tuple]:
    """Items below SHINGLE words are one shingle: windows of as many words, in longer documents, equal to it."""
    first: dict[tuple, tuple] = {}
    doc = table.doc_of()
    for size in (n for n in items.sizes if n < SHINGLE):
        own: dict[int, list[int]] = defaultdict(list)
        for i in items.index[size][0].tolist():
            own[items.only[i]].append(i)
        # Items of one word are met by the hash of grams of one, of two by grams of two, and so on.
        h, at = table.grams(size)
        for k in np.flatnonzero(np.isin(h, np.array(list(own), np.uint64))).tolist():
            d, word = int(doc[at[k]]), int(at[k])
            if table.counts[d] < SHINGLE:
                continue
            words = [table.raw[x:y].lower() for x, y in zip(table.starts[word : word + size].tolist(), table.ends[word : word + size].tolist(), strict=True)]
            for i in own[int(h[k])]:
                if items.shingles(i) == _counted(words):
                    first.setdefault((d, i), (ids[d], items.ids[i], 1.0, word - int(table.first[d]), size))
    return list(first.values())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every document for every item it leaks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if total > MAX_BENCHMARK_BYTES:
        return _scan_parts(docs, items, -(-total // MAX_BENCHMARK_BYTES))
    return _scan(docs, [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item. Rows without a doc_id are told by 64 bits of their texts."""
    found = leaks(docs.filter("doc_id is not null"), benchmark).select("doc_id").distinct()
    clean = docs.filter("doc_id is not null").join(found, "doc_id", "left_anti").select(*docs.columns)
    key = F.xxhash64("text")
    apart = docs.filter("doc_id is null")
    lost = leaks(apart.select(key.alias("doc_id"), "text").distinct(), benchmark).select(F.col("doc_id").alias(FREE)).distinct()
    return clean.unionByName(apart.join(lost, key == F.col(FREE), "left_anti").select(*docs.columns))
