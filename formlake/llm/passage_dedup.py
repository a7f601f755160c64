"""Removal of passages that stand in an earlier document: windows of words found by backward search in FM-indexes of shards.

Every window of `words` words has a minimizer, the run of MINIMIZER words in it of the least hash. Equal windows have equal
minimizers, so only windows whose minimizer occurs in two documents can be shared, and windows meet in the shard of their
minimizer. There, neighbouring windows of one minimizer form a segment. Equal segments are one first (least and largest
doc_id), so copies cost nothing; a minimizer that occurs more than HOT_ROWS times makes a segment of each window, in the
shard of the window, so that no shard grows with a frequent phrase. Each shard's segments make FM-indexes of bounded size;
the segments are streamed through their index, and the matching statistics of every window of full length give the interval
of its occurrences and the least doc_id there. A window with a smaller doc_id than a document's own covers words to remove.

A null text has no words. A document without a doc_id keeps its words and takes none from others. Rows that repeat a doc_id
are told apart by their texts (64 bits of the words); none takes words from another of the same doc_id, and each gets a
result row. Very long texts are cut into segments like any other, so only their own task holds them whole. Ties cannot
arise: the least doc_id keeps a passage. An empty table gives no rows; other columns are ignored. Windows are told by their
words; whole copies and equal segments are put together by 128 bits of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.durable import checkpointed
from formlake.llm.fm_index import FMIndex
from formlake.llm.kernels import CHUNK_BYTES, WordTable, sliced, texts_of

WORDS, MINIMIZER = 13, 4
#: Occurrences of a minimizer whose segments share one shard, at most.
HOT_ROWS = 4096
#: Words of an index, as soon as the segments of a minimizer are complete.
INDEX_WORDS = 1 << 16
#: Segments that a task puts together before it passes them on, and places that it passes on at once.
HELD, PLACES = 30_000, 100_000


def _minimizers(table: WordTable, words: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, the word at which its minimizer starts, and the hash there. The leftmost of equals counts."""
    h, at = table.grams(m)
    n = len(table.starts)
    dense = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    dense[at] = h
    doc = table.doc_of()
    if n < words:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(doc[: n - words + 1] == doc[words - 1 :])
    best, place = dense[first], first.copy()
    for j in range(1, words - m + 1):
        other = dense[first + j]
        less = other < best
        best = np.where(less, other, best)
        place[less] = first[less] + j
    return first, place, best


def packed(docs: DataFrame, known: bool = True) -> DataFrame:
    """doc_id, t (64 bits of the words), z: the texts compressed for the shuffle. known: no doc_id is null, which spares joins a filter that would tell their inputs apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches):
            texts = texts_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_digest(t)[0] for t in texts], pa.int64()), pa.array(map(pack, texts), pa.binary())], ["doc_id", "t", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long{' not null' * known}, t long not null, z binary")


def _digest(text: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(b" ".join(text.split()))
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts have about CHUNK_BYTES in all, and the texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at, size, texts = 0, 0, []
        for k, z in enumerate(batch.column("z")):
            texts.append(unpack(z.as_py()))
            size += len(texts[-1]) + 1
            if size >= CHUNK_BYTES:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = k + 1, 0, []
        if texts:
            yield batch.slice(at, len(texts)), texts


def minimizer_rows(texts: DataFrame, words: int = WORDS, m: int = MINIMIZER) -> DataFrame:
    """h, doc_id, n: the minimizers of each packed text, each once with the number of its places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, plain in _unpacked(batches):
            table = WordTable(plain)
            _, place, best = _minimizers(table, words, m)
            doc = table.doc_of()[place]
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            doc, best = doc[new], best[new]
            order = np.lexsort((best, doc))
            doc, best = doc[order], best[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])
            at = np.flatnonzero(new)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(best[at].view(np.int64)), pa.array(ids[doc[at]]), pa.array(np.diff(at, append=len(doc)).astype(np.int32))], ["h", "doc_id", "n"])

    return texts.select("doc_id", "z").mapInArrow(run, "h long not null, doc_id long not null, n int")


def _segments(batch: pa.RecordBatch, texts: list[bytes], words: int, m: int) -> tuple[np.ndarray, ...] | None:
    """The segments of some texts with shared minimizers (array `found` of h, hot): number of the text, its first word's number, shard (or none, -1, where the segment's own digest is it), first word and word after the last in the table, and the table.

    A minimizer is shared or not whatever the document, so the texts' lists are one.
    """
    flat = batch.column("found").flatten()
    shared, k = np.unique(flat.field("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_index=True)
    hot = flat.field("hot").to_numpy(zero_copy_only=False)[k]
    table = WordTable(texts)
    first, place, best = _minimizers(table, words, m)
    if not len(first) or not len(shared):
        return None
    at = np.minimum(np.searchsorted(shared, best), len(shared) - 1)
    ok = shared[at] == best
    first, place, best, is_hot = first[ok], place[ok], best[ok], hot[at[ok]].astype(bool)
    if not len(first):
        return None
    doc = table.doc_of()[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1) | is_hot[1:]
    a = np.flatnonzero(new)
    x, y = first[a], first[np.append(a[1:], len(first)) - 1] + words
    return doc[a], table.first[doc[a]], best[a].view(np.int64), is_hot[a], x, y, table


def contents(marked: DataFrame, words: int = WORDS, m: int = MINIMIZER) -> DataFrame:
    """shard, c1, c2 (128 bits of the words), content, low, high: segments, those that a task meets again put together (least and largest doc_id)."""

    def batch_of(held: dict) -> pa.RecordBatch:
        c = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
        shard, content, low, high = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(content, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["shard", "c1", "c2", "content", "low", "high"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch, texts in _unpacked(batches):
            if not (found := _segments(batch, texts, words, m)):
                continue
            doc, _, shard, hot, x, y, table = found
            joined, at = table.joined()
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            for d, s, h, i, j in zip(ids.tolist(), shard.tolist(), hot.tolist(), at[x].tolist(), (at[y] - 1).tolist(), strict=True):
                content = joined[i:j]
                key = xxhash.xxh3_128_digest(content)
                if got := held.get(key):
                    if d < got[2]:
                        got[2] = d
                    elif d > got[3]:
                        got[3] = d
                else:
                    held[key] = [int.from_bytes(key[:8], "little", signed=True) if h else s, content, d, d]
            if len(held) >= HELD:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    return marked.select("doc_id", "z", "found").mapInArrow(run, "shard long, c1 long, c2 long, content binary, low long, high long")


def places(marked: DataFrame, words: int = WORDS, m: int = MINIMIZER) -> DataFrame:
    """c1, c2, doc_id, t, first: where the segments stand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            if not (found := _segments(batch, texts, words, m)):
                continue
            doc, begin, _, _, x, y, table = found
            joined, at = table.joined()
            ids, t = (batch.column(k).to_numpy(zero_copy_only=False)[doc] for k in ("doc_id", "t"))
            digest = xxhash.xxh3_128_digest
            for k in range(0, len(x), PLACES):
                to = k + PLACES
                c = np.frombuffer(b"".join([digest(joined[i:j]) for i, j in zip(at[x[k:to]].tolist(), (at[y[k:to]] - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c[:, 0], c[:, 1], ids[k:to], t[k:to], (x - begin)[k:to].astype(np.int32))], ["c1", "c2", "doc_id", "t", "first"])

    return marked.select("doc_id", "t", "z", "found").mapInArrow(run, "c1 long, c2 long, doc_id long, t long, first int")


def search_block(contents: list[bytes], owners: np.ndarray, words: int = WORDS, asked: np.ndarray | None = None) -> list[np.ndarray]:
    """For each content, the least owner of every window of it over all contents, by one FM-index. asked: only these contents are searched for, the others have no windows."""
    split = [c.split(b" ") for c in contents]
    sizes = np.array([len(s) for s in split])
    symbols: dict[bytes, int] = {}
    flat = [symbols.setdefault(w, len(symbols) + 1) for s in split for w in (*s, b"")]
    text = np.array(flat, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    index = FMIndex(text, np.repeat(owners, sizes + 1), words)
    starts = ends - sizes
    windows = np.maximum(sizes - words + 1, 0)
    if asked is not None:
        windows = np.where(asked, windows, 0)
    firsts = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    length, low, high = index.matches(text, firsts + words - 1, words, own=True)
    assert (length == words).all()
    return np.split(index.least_value(low, high), np.cumsum(windows)[:-1])


def search_shards(parts: DataFrame, words: int = WORDS) -> DataFrame:
    """c1, c2, least (array of the least doc_id of each window) of contents with a window that a document of theirs has to give up."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
        held: tuple[list, ...] = ([], [], [], [], [], [])
        size, last = 0, (None,) * 3
        for batch in sliced(batches, "content"):
            for s, c1, c2, content, low, high in zip(*(batch.column(k).to_pylist() for k in ("shard", "c1", "c2", "content", "low", "high")), strict=True):
                if (s, c1, c2) == last:
                    held[4][-1], held[5][-1] = min(held[4][-1], low), max(held[5][-1], high)
                    continue
                if s != last[0] and size >= INDEX_WORDS:
                    yield held
                    held, size = ([], [], [], [], [], []), 0
                last = (s, c1, c2)
                for x, y in zip(held, (s, c1, c2, content, low, high), strict=True):
                    x.append(y)
                size += content.count(b" ") + 2
        if held[0]:
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, c1, c2, texts, low, high in blocks(batches):
            # A content none of whose documents comes after the first of its shard has nothing to give up.
            number = np.unique(np.array(shards), return_inverse=True)[1]
            first = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, number, np.array(low, np.int64))
            least = search_block(texts, np.array(low, np.int64), words, np.array(high, np.int64) > first[number])
            keep = [i for i, (x, top) in enumerate(zip(least, high, strict=True)) if len(x) and x.min() < top]
            columns = [pa.array([c1[i] for i in keep], pa.int64()), pa.array([c2[i] for i in keep], pa.int64()), pa.array([least[i].tolist() for i in keep], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "least"])

    return parts.repartition("shard").sortWithinPartitions("shard", "c1", "c2").mapInArrow(run, "c1 long, c2 long, least array<long>")


def covered_windows(texts: DataFrame, words: int = WORDS, m: int = MINIMIZER) -> DataFrame:
    """doc_id, covered (t and starts): first words of the windows of each packed text that start in a document with a smaller doc_id."""
    rows = minimizer_rows(texts, words, m)
    shared = rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"))
    shared = shared.filter("low < high").select("h", (F.col("n") > HOT_ROWS).alias("hot"))
    found = rows.join(shared, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "hot")).alias("found"))
    marked = texts.join(found, "doc_id")
    mine = places(marked, words, m).join(search_shards(contents(marked, words, m), words), ["c1", "c2"])
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("first") + i)), lambda i: i.isNotNull())
    mine = mine.select("doc_id", "t", starts.alias("starts")).filter(F.size("starts") > 0)
    return mine.groupBy("doc_id").agg(F.collect_list(F.struct("t", "starts")).alias("covered"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, t of each row whose whole words stand in a document with a smaller doc_id: told by 128 bits of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            half = np.array([_digest(t) for t in texts_of(batch.column("text"))], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(half[:, 0]), pa.array(half[:, 1])], ["doc_id", "t", "t2"])

    seen = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, t long, t2 long")
    first = seen.groupBy("t", "t2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return seen.join(first, ["t", "t2"]).filter(F.col("doc_id") > F.col("low")).select("doc_id", "t").distinct()


def remove_passages(docs: DataFrame, words: int = WORDS, m: int = MINIMIZER, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (with_text: and kept, the words left) of every document."""
    docs = docs.select("doc_id", "text")
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.filter("doc_id is not null")
    # Whole copies give up every window, so only the first of them is searched. The list of copies is written once.
    again = checkpointed(copies(known)).groupBy("doc_id").agg(F.collect_set("t").alias("copied"))
    # All joins with the texts ask for the same rows, so they are shuffled once.
    texts = packed(known).join(again, "doc_id", "left").select("doc_id", "t", "z", F.coalesce(F.array_contains("copied", F.col("t")), F.lit(False)).alias("copy"))
    joined = texts.join(covered_windows(texts.filter("not copy"), words, m), "doc_id", "left")
    apart = packed(docs.filter("doc_id is null"), known=False).select("doc_id", "t", "z", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<t:bigint,starts:array<int>>>").alias("covered"))
    joined = joined.select("doc_id", "t", "z", "copy", "covered").unionByName(apart)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for text, t, covered, copy in zip(texts, *(batch.column(k).to_pylist() for k in ("t", "covered", "copy")), strict=True):
                kept = tokens = text.split()
                if copy and len(tokens) >= words:
                    kept = []
                elif starts := [i for c in covered or () if c["t"] == t for i in c["starts"]]:
                    edge = np.zeros(len(tokens) + 1, np.int64)
                    s = np.unique(np.array(starts))
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + words, -1)
                    kept = [tokens[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                left = b" ".join(kept)
                for x, y in zip(out, (len(tokens), len(tokens) - len(kept), hashlib.sha256(left).hexdigest(), left if with_text else b""), strict=True):
                    x.append(y)
            columns = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if with_text else done.drop("kept")
