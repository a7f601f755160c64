"""Token ids of a corpus as binary blocks, and back.

Documents are dealt by ranges of doc_id (nulls first; rows of one doc_id by a hash of their text), so the files in order of their
names hold the ids of all documents in ascending order of doc_id, each followed by an end id. The stream of a task is cut into blocks of
4,096 ids (the last has fewer), which are coded by `id_coder` each from nothing. A block is a string of bytes that can be read by itself:

    "FLT3", then as unsigned 32-bit integers (little-endian): ids, segments, distinct ids, bytes of the list of these, crc32 of the ids;
    for each segment of a document: doc_id (64 bits), flags (8 bits; 1: begins here, 2: ends here, 4: no doc_id), ids (32 bits);
    the distinct ids in ascending order, each as the difference from the one before in groups of seven bits;
    the code; the crc32 of all this.

Files are Parquet tables of such blocks beside their place (part, first id within the part, number of the first document), so any store that
Spark writes to can hold them. Both checksums are held against the data when blocks are read; a block that fails raises an error.

A null text is an empty one and has its end id only. A very long text goes through many blocks. Rows that repeat a doc_id are
documents of their own, as often as they come; an empty table gives files without blocks, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm.id_coder import BLOCK_IDS, LANES, decode_blocks, encode_blocks
from formlake.llm.kernels import sliced
from formlake.llm.token_codec import Vocabulary, default_path
from formlake.llm.units import BATCH_BYTES, IndexedMemory, joined, runs, stand_apart

#: What follows the ids of each document.
END_ID = 2
#: Bytes of the units that a worker remembers.
MEMORY_BYTES = 96 << 20
MAGIC, _HEAD, _BEGINS, _ENDS, _UNNAMED = b"FLT3", struct.Struct("<5I"), 1, 2, 4
_SEGMENT = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("n", "<u4")])


#: New units that go through the library as one text, in bytes.
JOINED_BYTES = 4096


class LibraryIds:
    """Ids by the tokenizers library. Each unit is encoded once by a worker and remembered, as its ids do not depend on its neighbours."""

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(blob.decode())
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = Vocabulary(blob)
        self.sizes = np.array(list(map(len, vocabulary.tokens)), np.int64)
        self.special = [s.encode() for s in vocabulary.special]
        self.memory = IndexedMemory(self._encoded, 1, self.special, MEMORY_BYTES)

    def _encoded(self, units: pa.Array) -> list[pa.Array]:
        """The ids of each unit as bytes. Units that stay apart in one text are encoded many together, and told by the sizes of the tokens."""
        apart = stand_apart(units)
        for s in self.special:
            apart &= ~pc.match_substring(units, s).to_numpy(zero_copy_only=False)
        order = np.argsort(~apart, kind="stable")
        raw, at = runs(units.take(pa.array(order)))
        many = int(apart.sum())
        # Of the first `many` units some thousand bytes make a text, each of the others is one.
        cuts = [*(np.flatnonzero(np.diff(at[:many] // JOINED_BYTES, prepend=-1)).tolist()), *range(many, len(order) + 1)]
        texts = [str(raw[a:b], "utf-8") for a, b in zip(at[cuts[:-1]].tolist(), at[cuts[1:]].tolist(), strict=True)]
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in encoded)]).astype("<u4")
        ends = np.cumsum(self.sizes[ids])
        found = np.searchsorted(ends, at[1:])
        if len(at) > 1 and (found[-1] != len(ids) - 1 or (ends[found] != at[1:]).any()):
            raise ValueError("a token goes over the border of two units")
        got = joined(np.concatenate([[0], 4 * (found + 1)]), ids.tobytes())
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return [got.take(pa.array(back))]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, an end id after each, and how many each has with it."""
        (found,), first = self.memory.find(texts)
        raw, at = runs(found)
        of_text = at[first] // 4
        return np.insert(np.frombuffer(raw, "<u4"), of_text[1:], END_ID), np.diff(of_text) + 1


#: The library of a worker that is used again, by the tokenizer file's checksum and size: what it remembers serves the next task too.
_libraries: dict[tuple[int, int], LibraryIds] = {}


def _library(blob: bytes) -> LibraryIds:
    key = (zlib.crc32(blob), len(blob))
    if key not in _libraries:
        _libraries.clear()
        _libraries[key] = LibraryIds(blob)
    return _libraries[key]


def _leb(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2**35 in groups of seven bits, the lowest first; the top bit says that more follow. And where each ends."""
    many = 1 + sum((numbers >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    ends = np.cumsum(many)
    begin = ends - many
    out = np.zeros(int(many.sum()), np.uint8)
    for k in range(int(many.max(initial=0))):
        some = np.flatnonzero(many > k)
        out[begin[some] + k] = (numbers[some] >> (7 * k)) & 127 | np.where(many[some] > k + 1, 128, 0)
    return out.tobytes(), ends


def _unleb(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    ends = np.flatnonzero(x < 128)
    begin = np.concatenate([[0], ends[:-1] + 1])
    return np.add.reduceat((x & 127) << (7 * (np.arange(len(x)) - np.repeat(begin, ends - begin + 1))), begin) if len(x) else x


def _groups(n: int) -> list[tuple[int, int]]:
    """As few runs of at most LANES of n blocks as can be, equally long."""
    many = -(-n // LANES)
    at = [n * i // many for i in range(many + 1)] if n else []
    return list(zip(at, at[1:], strict=False))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _numbered(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, and the number of each id among them. place: a cell for each id below 2**16, used anew."""
    if int(ids.max()) >= len(place):
        return np.unique(ids, return_inverse=True)
    order = np.sort(ids.astype(np.uint16), kind="stable")
    first = np.empty(len(order), bool)
    first[0] = True
    np.not_equal(order[1:], order[:-1], first[1:])
    known = order[first]
    place[known] = np.arange(len(known))
    return known, place[ids]


def pack_blocks(ids: np.ndarray, segments: np.ndarray) -> list[bytes]:
    """Blocks of a stream of ids whose segments (doc_id, flags, n) say where documents begin and end; both flags of a segment that a block's border cuts are set anew."""
    cuts = np.append(np.arange(0, len(ids), BLOCK_IDS), len(ids))
    parts = [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
    place = np.zeros(1 << 16, np.int16)
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    codes: list[bytes] = [b""] * len(parts)
    known: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    for a, b in _groups(len(order)):
        own = order[a:b]
        sizes = np.array([len(parts[i]) for i in own], np.int64)
        symbols = np.zeros((len(own), int(sizes.max())), np.int16)
        for j, i in enumerate(own):
            known[i], symbols[j, : sizes[j]] = _numbered(parts[i], place)
        for i, code in zip(own, encode_blocks(symbols.T, sizes, np.array([len(known[i]) for i in own])), strict=True):
            codes[i] = code
    # The names of all blocks one after another; the first of each stands for itself.
    distinct = np.array(list(map(len, known)), np.int64)
    upto = np.cumsum(distinct)
    steps = np.diff(np.concatenate([np.zeros(1, np.int64), *(x.astype(np.int64) for x in known)]))
    if len(parts):
        steps[upto[:-1]] = [int(x[0]) for x in known[1:]]
    names, ends = _leb(steps)
    name_at = np.concatenate([[0], ends[upto - 1]]).tolist()
    # The segments of each block: those of documents, cut at the borders.
    ends = np.cumsum(segments["n"].astype(np.int64))
    begins = ends - segments["n"]
    blocks = []
    for i, (a, b, left, right) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), np.searchsorted(ends, cuts[:-1], "right").tolist(), np.searchsorted(begins, cuts[1:], "left").tolist(), strict=False)):
        own = slice(left, right)
        some = segments[own].copy()
        some["n"] = np.minimum(ends[own], b) - np.maximum(begins[own], a)
        some["flags"] &= ~(np.where(begins[own] < a, _BEGINS, 0) | np.where(ends[own] > b, _ENDS, 0)).astype(np.uint8)
        named = names[name_at[i] : name_at[i + 1]]
        body = MAGIC + _HEAD.pack(b - a, len(some), len(known[i]), len(named), _crc(parts[i])) + some.tobytes() + named + codes[i]
        blocks.append(body + struct.pack("<I", zlib.crc32(body)))
    return blocks


def unpack_blocks(blocks: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and segments (doc_id, flags, n) of each block."""
    heads, segments, names, codes = [], [], [], []
    for raw in blocks:
        if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("not a block of token ids, or a damaged one")
        n, many, distinct, size, crc = _HEAD.unpack_from(raw, 4)
        at = 4 + _HEAD.size + many * _SEGMENT.itemsize
        heads.append((n, distinct, crc))
        segments.append(np.frombuffer(raw, _SEGMENT, many, 4 + _HEAD.size))
        names.append(raw[at : at + size])
        codes.append(raw[at + size : -4])
    ends = np.cumsum([d for _, d, _ in heads])
    total = np.concatenate([[0], np.cumsum(_unleb(b"".join(names)))])
    known = [(total[b - d + 1 : b + 1] - total[b - d]).astype(np.uint32) for b, (_, d, _) in zip(ends.tolist(), heads, strict=True)]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    for a, b in _groups(len(order)):
        own = order[a:b]
        symbols = np.ascontiguousarray(decode_blocks([codes[i] for i in own], np.array([heads[i][0] for i in own]), np.array([heads[i][1] for i in own])).T)
        for j, i in enumerate(own):
            out[i] = known[i][symbols[j, : heads[i][0]]]
            if _crc(out[i]) != heads[i][2]:
                raise ValueError("the ids of a block differ from its checksum")
    return out, segments


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Writes the ids of every whole text to files in a new folder."""
    with open(path or default_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows of one doc_id may be many: their texts' hashes deal them out further.
    dealt = texts.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, first, document = _library(sent.value), TaskContext.get().partitionId(), 0, -1
        ids, segments, held = [], [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """All whole blocks, at the end the rest too; what is left of a document goes on in the next."""
            nonlocal ids, segments, held, first, document
            stream, marks = np.concatenate(ids), np.concatenate(segments)
            cut = len(stream) if last else len(stream) // BLOCK_IDS * BLOCK_IDS
            ends = np.cumsum(marks["n"].astype(np.int64))
            k = int(np.searchsorted(ends, cut, "left")) + 1
            now, rest = marks[:k].copy(), marks[k:]
            if over := int(ends[k - 1] - cut):
                now["n"][-1] -= over
                now["flags"][-1] &= ~_ENDS & 255
                rest = np.concatenate([marks[k - 1 : k], rest])
                rest["n"][0] = over
                rest["flags"][0] &= ~_BEGINS & 255
            raw = pack_blocks(stream[:cut], now)
            sizes = [min(BLOCK_IDS, cut - a) for a in range(0, cut, BLOCK_IDS)]
            # The number of each block's first segment's document: documents that began up to there.
            began = np.cumsum((now["flags"] & _BEGINS).astype(np.int64))
            at = np.searchsorted(ends[:k], np.arange(0, cut, BLOCK_IDS), "right")
            numbers = document + began[at]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(raw), pa.int32()), pa.array([first + a for a in range(0, cut, BLOCK_IDS)], pa.int64()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], ["part", "first", "document", "n", "block"])
            document, first = document + int(began[-1]), first + cut
            ids, segments, held = [stream[cut:]], [rest], len(stream) - cut

        for batch in sliced(batches, limit=BATCH_BYTES):
            got, counts = library.ids(batch.column("text"))
            names = batch.column("doc_id")
            marks = np.zeros(len(counts), _SEGMENT)
            marks["doc_id"], marks["n"] = names.fill_null(0).to_numpy(zero_copy_only=False), counts
            marks["flags"] = _BEGINS | _ENDS | np.where(names.is_null().to_numpy(zero_copy_only=False), _UNNAMED, 0)
            ids.append(got)
            segments.append(marks)
            held += len(got)
            if held >= BLOCK_IDS * LANES:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    dealt.select("doc_id", "text").mapInArrow(run, "part int, first long, document long, n int, block binary").write.parquet(folder)


def _shift(n: int, known: dict[int, list[int]]) -> list[int]:
    """What n further zero bytes make of each bit of a crc32."""
    if n not in known:
        if n == 1:
            rows = []
            for k in range(32):
                x = 1 << k
                for _ in range(8):
                    x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
                rows.append(x)
            known[n] = rows
        else:
            half = _shift(n // 2, known)
            rows = [_applied(half, x) for x in half]
            known[n] = [_applied(_shift(1, known), x) for x in rows] if n % 2 else rows
    return known[n]


def _applied(rows: list[int], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= rows[low.bit_length() - 1]
        x ^= low
    return out


def _segments(spark: SparkSession, folder: str) -> tuple[DataFrame, Callable]:
    """The blocks of a folder, and what makes of a batch of them: doc_id, part, document, first, begins, ends of each segment, and the ids of all with the segments' places in them."""
    blocks = spark.read.schema("part int, first long, document long, n int, block binary").parquet(folder)
    # A row for each part: as many as tasks that wrote.
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = dict(zip((r.part for r in sizes), accumulate((r.n for r in sizes), initial=0), strict=False))
    sent = spark.sparkContext.broadcast(before)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        for batch in batches:
            for k, end in _groups(batch.num_rows):
                part, first, document, block = (batch.slice(k, end - k).column(c).to_pylist() for c in ("part", "first", "document", "block"))
                ids, marks = unpack_blocks(block)
                flat, segments, many = np.concatenate(ids), np.concatenate(marks), [len(m) for m in marks]
                at = np.concatenate([[0], np.cumsum(segments["n"].astype(np.int64))])
                # From a place in these blocks to one in the whole stream, block by block.
                ahead = np.array([sent.value[p] + f for p, f in zip(part, first, strict=True)]) - np.cumsum([0, *map(len, ids[:-1])])
                number = np.array(document) - np.cumsum([0, *many[:-1]])
                flags = segments["flags"]
                columns = {
                    "doc_id": pa.array(segments["doc_id"], mask=(flags & _UNNAMED) > 0),
                    "part": pa.array(np.repeat(np.array(part, np.int32), many)),
                    "document": pa.array(np.repeat(number, many) + np.arange(len(segments))),
                    "first": pa.array(np.repeat(ahead, many) + at[:-1]),
                    "begins": pa.array((flags & _BEGINS) > 0),
                    "ends": pa.array((flags & _ENDS) > 0),
                }
                yield columns, flat, at

    return blocks.select("part", "first", "document", "block"), read


_KIND = "doc_id long, part int, document long, first long, begins boolean, ends boolean"


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, part, document (its number in the part), first (ids of all documents before the segment), begins, ends, ids: a row for each segment of a document that the files hold."""
    blocks, read = _segments(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, flat, at in read(batches):
            columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)

    return blocks.mapInArrow(run, f"{_KIND}, ids array<long>")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files. Segments of one document are summed up each by itself, then their checksums are joined."""
    blocks, read = _segments(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, flat, at in read(batches):
            raw, n = memoryview(flat.astype("<u4").tobytes()), np.diff(at)
            columns["n"] = pa.array(n)
            columns["crc"] = pa.array([zlib.crc32(raw[a:b]) for a, b in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                crc = parts[0]["crc"]
                for x in parts[1:]:
                    crc = _applied(_shift(4 * x["n"], known), crc) ^ x["crc"]
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(run, f"{_KIND}, n long, crc long")
    # A document's list has a row for each block that it goes through.
    whole = found.groupBy("part", "document").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first", "n", "crc"))).alias("parts")
    )
    return whole.select("doc_id", "start", "n_tokens", "parts").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
