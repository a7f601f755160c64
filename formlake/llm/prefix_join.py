"""Links between texts of a Jaccard similarity over word shingles, found by prefixes of their shingle sets and verified on whole texts.

In any order common to all, two sets of the similarity share a member among the first n - ceil(similarity * n) + 1 of each
(n members), so pairs are looked for only where prefixes meet. The order puts the most frequent shingles last (a list of
bounded size, counted over all documents) and is by hash else, so frequent lines and passages are in no prefix but of texts made
of little else. Sizes and parity sketches in proportion to the texts rule out pairs that cannot be similar.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.durable import checkpointed
from formlake.llm.frequent import most_frequent
from formlake.llm.kernels import WordTable, chunks, sliced, texts_of

#: Rows of a place in one block of comparisons, rows of a frequent place that one least text is sought among, and what keeps rounding from ruling out a pair.
BLOCK_ROWS, STAR_ROWS, SLACK = 2048, 2000, 1e-6
#: Rows of a partition: of pairs, of places, of texts' profiles.
PAIR_ROWS, PLACE_ROWS, TEXT_ROWS = 20_000, 200_000, 20_000
#: Cells of the filter of documents whose texts are compared.
FILTER_BITS = 1 << 24
#: Shingles that the order puts last, at most (eight bytes and a part each are sent to all tasks), and texts that a frequent one stands in, at least.
COMMON, COMMON_ROWS = 1 << 21, 3
#: Bytes of the coarse sketch, at most.
COARSE = 256


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text (compressed) of the documents of the ids, and of few others: a filter of fixed size is sent to all tasks, so that not all texts are shuffled."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros(FILTER_BITS // 64, np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.column("cell").to_numpy(zero_copy_only=False).astype(np.uint64)
            some = batch.filter(pa.array((sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for part in sliced([some]):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(pack, texts_of(part.column("text"))), pa.binary())], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return rows.select("doc_id", "text", cell.alias("cell")).mapInArrow(run, "doc_id long, text binary")


def _shingles(text: bytes, k: int) -> set:
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def similar_links(found: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose whole texts have a Jaccard similarity of `similarity` or more over shingles of `shingle` lower-cased words."""
    found = checkpointed(found.distinct(), PAIR_ROWS)
    texts = packed_texts(docs, found.select(F.explode(F.array("a", "b")).alias("doc_id")))
    pairs = found.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = _shingles(unpack(left.as_py()), shingle), _shingles(unpack(right.as_py()), shingle)
                keep.append(len(x & y) >= similarity * len(x | y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of some texts, and the text's number of each, in order of both."""
    table = WordTable(texts, lower=True)
    h, at = table.grams(shingle)
    doc = table.doc_of()[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], doc[fresh]


def _prefix(doc: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of members in order: which are in their set's prefix, and the prefixes' sizes."""
    size = np.where(n > 0, n - np.ceil(similarity * n - SLACK).astype(np.int64) + 1, 0)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(size, n), size


def common_shingles(docs: DataFrame, shingle: int, similarity: float, limit: int | None = None, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the shingles in prefixes by hash, in order, and the parts of each: at most `limit`, each in `rows` texts or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            h, doc = _sets(texts, shingle)
            first, _ = _prefix(doc, np.bincount(doc, minlength=len(texts)), similarity)
            keys, counts = np.unique(h[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], ["h", "n"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    top = most_frequent(checkpointed(counts.filter(F.col("n") >= (rows or COMMON_ROWS)), PLACE_ROWS), limit or COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    # The parts that a frequent shingle's texts are divided into.
    return h[order], np.ceil(n[order] / STAR_ROWS).astype(np.int32)


def _member(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and where."""
    if not len(known):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h, at


def profiles(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """doc_id, k1, k2 (of equal word sequences), n (distinct shingles), fp (their SimHash), sketch (parity of shingles in cells, a power of two from 2 n on), coarse (the same in COARSE bytes at most) and places: the prefix, each with a part, which divides frequent places evenly (0: not a frequent place)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = sent.value
        for ids, texts in chunks(batches):
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]), np.int64).reshape(-1, 2)
            h, doc = _sets(texts, shingle)
            n = np.bincount(doc, minlength=len(texts))
            ends = np.cumsum(n)
            # SimHash of the set: bits set in over half of the hashes.
            fp = np.zeros(len(texts), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                sums = np.add.reduceat(np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64), (ends - n)[full], axis=0, dtype=np.int32)
                fp[full] = np.packbits(2 * sums > n[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
            cells = np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
            begin = np.cumsum(cells) - cells
            flat = np.bincount(begin[doc] + (h & (cells[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(cells.sum()))
            raw = np.packbits((flat & 1).astype(bool)).tobytes()
            sketch = [raw[a : a + c] for a, c in zip((begin // 8).tolist(), (cells // 8).tolist(), strict=True)]
            coarse = [_folded(x) for x in sketch]
            frequent, at = _member(h, known)
            order = np.lexsort((h, frequent, doc))
            first, size = _prefix(doc, n, similarity)
            own = order[first]
            # Copies have one key, so a class is in one part of each place.
            part = np.where(frequent[own], keys[doc[own], 0] % parts[at[own]] + 1 if len(parts) else 0, 0).astype(np.int32)
            places = pa.StructArray.from_arrays([pa.array(h[own].view(np.int64)), pa.array(part)], ["place", "part"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            columns = [pa.array(ids, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n, pa.int64()), pa.array(fp.view(np.int64)), pa.array(sketch, pa.binary()), pa.array(coarse, pa.binary()), pa.ListArray.from_arrays(offsets, places)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n", "fp", "sketch", "coarse", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n long, fp long, sketch binary, coarse binary, places array<struct<place:long,part:int>>")


def stars(places: DataFrame) -> DataFrame:
    """place, rep, least: of each part of a place (place, part, rep) each further rep with the part's least; the least of the parts with their least."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rep_, least_ = None, None, 0
        for batch in batches:
            place, part, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("place", "part", "rep"))
            if not len(place):
                continue
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
            new[0] = (place[0], part[0]) != last
            again = np.zeros(len(place), bool)
            again[1:] = rep[1:] == rep[:-1]
            again[0] = rep[0] == rep_
            start = np.maximum.accumulate(np.where(new, np.arange(len(place)), -1))
            least = np.where(start >= 0, rep[start], least_)
            keep = ((rep != least) & ~(again & ~new)) | (new & (part > 0))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (place, rep, least)], ["place", "rep", "least"])
            last, rep_, least_ = (place[-1], part[-1]), rep[-1], least[-1]

    return places.repartition("place", "part").sortWithinPartitions("place", "part", "rep").mapInArrow(run, "place long, rep long, least long")


def _may(n: np.ndarray, m: np.ndarray, differ: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m members can have the similarity: the members that only one of them has are at least as many as `differ`, the cells of odd parity."""
    return (1 + similarity) * np.maximum(differ, np.abs(n - m)) <= (1 - similarity) * (n + m) + SLACK


def _cells(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _halved(cells: np.ndarray) -> np.ndarray:
    """Sketches in half as many cells."""
    half = cells.shape[1] // 2
    return cells[:, :half] ^ cells[:, half:]


def _folded(sketch: bytes) -> bytes:
    if len(sketch) <= COARSE:
        return sketch
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, COARSE // 8), axis=0).tobytes()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not connected by what was found (node, component)."""
    for k in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")), k, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def likely_pairs(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "sketch_a"):
            x, y = (batch.column(k).to_pylist() for k in ("sketch_a", "sketch_b"))
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            differ = np.zeros(len(x), np.int64)
            for p, q in np.unique(sizes, axis=0).tolist():
                if max(p, q) > 2 * min(p, q):
                    continue
                at = np.flatnonzero((sizes[:, 0] == p) & (sizes[:, 1] == q))
                left, right = _cells([x[i] for i in at]), _cells([y[i] for i in at])
                left, right = _halved(left) if p > q else left, _halved(right) if q > p else right
                differ[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            ok = _may(*(batch.column(k).to_numpy(zero_copy_only=False) for k in ("n_a", "n_b")), differ, similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    for k in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")), k)
    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _bucket_pairs(component: np.ndarray, n: np.ndarray, sketch: list[bytes], similarity: float) -> Iterator[np.ndarray]:
    """Likely pairs (two rows' numbers) of unlike components in one bucket, some at a time."""
    width = np.array([len(s) for s in sketch])
    classes = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    for w, own in classes.items():
        cells = _cells([sketch[i] for i in own])
        sides = [(own, cells)]
        if (wide := classes.get(2 * w)) is not None:
            sides.append((wide, _halved(_cells([sketch[i] for i in wide]))))
        for other, against in sides:
            step = max(1, (1 << 20) // max(1, against.size))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                ok = (component[rows, None] != component[None, other]) & ((rows[:, None] < other[None, :]) if other is own else True)
                ok &= _may(n[rows, None], n[None, other], np.zeros((1, 1), np.int64), similarity)
                x, y = np.nonzero(ok)
                if len(x):
                    differ = np.concatenate([np.bitwise_count(cells[at + x[k : k + 65536]] ^ against[y[k : k + 65536]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 65536)])
                    good = _may(n[rows[x]], n[other[y]], differ, similarity)
                    yield np.stack([rows[x[good]], other[y[good]]], axis=1)


def _forest(pairs: Iterator[np.ndarray], component: np.ndarray) -> Iterator[np.ndarray]:
    """Of pairs only as many as connect what all of them connect."""
    label = np.unique(component, return_inverse=True)[1]
    for some in pairs:
        kept = []
        some = some[label[some[:, 0]] != label[some[:, 1]]]
        while len(some):
            x, y = some[0]
            kept.append((x, y))
            label[label == label[y]] = label[x]
            some = some[label[some[:, 0]] != label[some[:, 1]]]
        yield np.array(kept, np.int64).reshape(-1, 2)


def open_pairs(members: DataFrame, reps: DataFrame, found: DataFrame, similarity: float, forest: bool, block_rows: int | None = None) -> DataFrame:
    """The pairs (a, b) that share a place (members: place, rep), are not connected by what was found and are not ruled out by sizes and sketches. forest: of each block only as many as connect them."""
    block_rows = block_rows or BLOCK_ROWS
    named = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("place", "rep", F.coalesce("component", "rep").alias("component"))
    named = checkpointed(named, PLACE_ROWS)
    mixed = named.groupBy("place").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).filter("x <> y").select("place", "rows")
    rows = named.join(mixed, "place").join(reps.select("rep", "n", F.col("coarse").alias("sketch")), "rep")
    # A place of many rows is compared in blocks, two at a time, so that no task holds all its rows.
    blocks = F.ceil(F.col("rows") / block_rows)
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    order = ["place", "i", "j"]
    rows = rows.select("place", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "rep", "component", "n", "sketch").repartition(*order).sortWithinPartitions(*order)

    def compared(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        """The pairs of buckets that begin at `starts`; the last start is the end."""
        rep, component, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "component", "n"))
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a > 1:
                own = slice(a, b)
                found_ = _bucket_pairs(component[own], n[own], rows.column("sketch").slice(a, b - a).to_pylist(), similarity)
                pairs += [np.sort(rep[own][p], axis=1) for p in (_forest(found_, component[own]) if forest else found_)]
        out = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come bucket after bucket; no more is held than a batch and the bucket that goes on in the next.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in order])
            starts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in order):
                starts = [0, *starts]
            if not starts:
                held.append(batch)
                continue
            before = pa.concat_batches([*held, batch.slice(0, starts[0])])
            yield compared(before, [0, before.num_rows])
            yield compared(batch, starts)
            held = [batch.slice(starts[-1])]
        if held:
            rest = pa.concat_batches(held)
            yield compared(rest, [0, rest.num_rows])

    return likely_pairs(rows.mapInArrow(run, "a long, b long").filter("a <> b").distinct(), reps, similarity)
