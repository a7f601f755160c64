"""Byte-level BPE by a lexicon of frequent words, compiled into a minimal acyclic transducer, and exact merges of the rest.

The transducer shares prefixes and suffixes; each arc carries a number, and the numbers along a word's path add up to the
word's place in a table of id runs. Its arrays are mapped into memory from a file that every worker writes for itself and
unlinks at once. A word that the lexicon lacks is merged exactly, many words at a time. The lexicon only saves work: ids do
not depend on it. It is made of the most frequent words of all documents, counted by summaries of bounded size; words as
frequent as each other are in it or out of it together.

A null text is an empty one; it has no ids and decodes to the empty text. A very long text is encoded whole; no more than one
such text is held besides the bounded memory. Repeated rows are encoded alike, an empty table gives an empty result, and other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.durable import checkpointed
from formlake.llm.frequent import most_frequent
from formlake.llm.kernels import sliced
from formlake.llm.units import BATCH_BYTES, UnitMemory, joined, runs, units

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon, and words that a summary of frequent words holds, at most.
LEXICON_WORDS, SUMMARY_WORDS = 30_000, 30_000
#: Characters of a word in the lexicon or its summaries, at most.
WORD_CHARS = 64
#: Bytes of the units that a worker remembers.
MEMORY_BYTES = 96 << 20
#: Longer words are merged one by one by a heap instead of all together in a matrix.
MATRIX_BYTES = 64
#: Words merged together: their matrices stay in the CPU's caches.
ROWS = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where it is printable, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        of = _byte_chars()
        model = spec["model"]
        size = max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.tokens = [b""] * size
        for token, i in model["vocab"].items():
            self.tokens[i] = bytes(of[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.byte_ids = np.array([model["vocab"][c] for c, _ in sorted(of.items(), key=lambda x: x[1])], np.int64)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        known = [(model["vocab"][a] << 20 | model["vocab"][b], rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)]
        self.rank = {key: (rank, to) for key, rank, to in known}
        # An open-addressed table for many lookups at once: pair of ids to rank and merged id.
        bits = max(4, (4 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.steps = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        for key, rank, to in known:
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.steps[at] = key, rank << 20 | to

    def _slot(self, key: int) -> int:
        return ((key * _SPREAD) & ((1 << 64) - 1)) >> int(self.shift)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair of ids in one number, _NONE for pairs that do not merge."""
        key = left.astype(np.int64) << 20 | right
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> self.shift).view(np.int64)
        got = self.keys[at]
        out = np.where(got == key, self.steps[at], _NONE)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        key, at = key[open_], at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            got = self.keys[at]
            out[open_] = np.where(got == key, self.steps[at], _NONE)
            more = (got != key) & (got >= 0)
            open_, key, at = open_[more], key[more], at[more]
        return out

    def merge_one(self, word: bytes) -> list[int]:
        """Exact merges of one word: the lowest rank first, the leftmost of equals, by a heap over a linked list."""
        import heapq

        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and (got := self.rank.get(ids[i] << 20 | ids[j])):
                heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merges of many words: in every round each word makes its one best merge."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), ROWS):
            some = [i for i in order[at : at + ROWS] if len(words[i]) <= MATRIX_BYTES]
            for i in order[at : at + ROWS]:
                if len(words[i]) > MATRIX_BYTES:
                    out[i] = self.merge_one(words[i])
            if some:
                for i, ids in zip(some, self._matrix([words[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max())
        ids = np.full((len(words), wide + 1), -1, np.int32)
        there = np.arange(wide + 1) < sizes[:, None]
        ids[there] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        # Of each pair of neighbours: rank and merged id in one number, so the least is the next merge, the leftmost of equals.
        step = np.full((len(words), wide), _NONE, np.int64)
        pair = there[:, 1:]
        step[pair] = self.find(ids[:, :-1][pair], ids[:, 1:][pair])
        result: list[list[int]] = [[]] * len(words)
        live, cols = np.arange(len(words)), np.arange(wide)
        while True:
            best = step.argmin(axis=1)
            rows = np.arange(len(live))
            least = step[rows, best]
            done = least == _NONE
            if done.any():
                stay = ids[done]
                full = (stay >= 0).sum(axis=1).tolist()
                for i, row, n in zip(live[done].tolist(), stay.tolist(), full, strict=True):
                    result[i] = row[:n]
                keep = ~done
                live, ids, step, best, least = live[keep], ids[keep], step[keep], best[keep], least[keep]
                rows = rows[: len(live)]
            if not len(live):
                return result
            # The merged pair becomes one id; what follows moves one place to the left.
            behind = cols > best[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=behind)
            ids[:, -1] = -1
            ids[rows, best] = least & 0xFFFFF
            np.copyto(step[:, :-1], step[:, 1:].copy(), where=behind[:, :-1])
            step[:, -1] = _NONE
            for at in (best - 1, best):
                ok = np.flatnonzero(at >= 0)
                a = at[ok]
                x, y = ids[ok, a], ids[ok, a + 1]
                new = np.full(len(ok), _NONE, np.int64)
                both = y >= 0
                new[both] = self.find(x[both], y[both])
                step[ok, a] = new


_NONE = np.int64(2**62)
_SPREAD = 0x9E3779B97F4A7C15


class Transducer:
    """A minimal acyclic transducer from words to id runs, in flat arrays."""

    NAMES = ("arc_keys", "arc_to", "arc_add", "final", "run_at", "run_ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        for k, v in arrays.items():
            setattr(self, k, v)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        """From words and their ids: words in order are added one by one, and finished states that equal a known one are shared."""
        entries = sorted(words)
        states: list[tuple[bool, dict[int, int]]] = [(False, {})]
        known: dict[tuple, int] = {}
        trail: list[tuple[int, int]] = []  # (state, byte) from the start along the last word

        def settle(down_to: int) -> None:
            while len(trail) > down_to:
                parent, byte = trail.pop()
                child = states[parent][1][byte]
                shape = (states[child][0], tuple(states[child][1].items()))
                states[parent][1][byte] = known.setdefault(shape, child)

        last = b""
        for word in entries:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            settle(same)
            at = states[trail[-1][0]][1][trail[-1][1]] if trail else 0
            for byte in word[same:]:
                states.append((False, {}))
                states[at][1][byte] = len(states) - 1
                trail.append((at, byte))
                at = len(states) - 1
            states[at] = (True, states[at][1])
            last = word
        settle(0)
        # Words below each state, then the number of words that sort before an arc's: numbers along a path add up to the word's place.
        number, below, stack = {}, {}, [0]
        while stack:
            s = stack[-1]
            todo = [t for t in states[s][1].values() if t not in below]
            if todo:
                stack += todo
                continue
            stack.pop()
            if s not in below:
                below[s] = states[s][0] + sum(below[t] for t in states[s][1].values())
                number[s] = len(number)
        arcs = []
        for s, n in number.items():
            add = int(states[s][0])
            for byte, t in sorted(states[s][1].items()):
                arcs.append((n << 8 | byte, number[t], add))
                add += below[t]
        arcs.sort()
        column = lambda i, kind: np.array([a[i] for a in arcs], kind)
        final = np.zeros(len(number), bool)
        for s, n in number.items():
            final[n] = states[s][0]
        runs = [words[w] for w in entries]
        return cls(
            {
                "arc_keys": column(0, np.int64),
                "arc_to": column(1, np.int32),
                "arc_add": column(2, np.int32),
                "final": final,
                "run_at": np.cumsum([0, *map(len, runs)]).astype(np.int64),
                "run_ids": np.array([i for r in runs for i in r], np.int32),
            }
        )

    @property
    def start(self) -> int:
        return len(self.final) - 1

    def pack(self) -> tuple[bytes, list[tuple[str, str, int, int]]]:
        """One block of bytes, and (name, type, place, length) of each array."""
        blob, index = b"", []
        for k in self.NAMES:
            x = np.ascontiguousarray(self.arrays[k])
            blob += b"\0" * (-len(blob) % 8)
            index.append((k, x.dtype.str, len(blob), len(x)))
            blob += x.tobytes()
        return blob or b"\0", index

    @classmethod
    def mapped(cls, blob: bytes, index: list[tuple[str, str, int, int]]) -> Transducer:
        """The arrays over a memory-mapped file; the file's name is gone as soon as it is mapped."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return cls({k: np.frombuffer(view, kind, n, at) for k, kind, at, n in index})

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The id run of each word, None for words that are not in the lexicon: all words take a step at once."""
        out: list[list[int] | None] = [None] * len(words)
        if not len(self.arc_keys) or not words:
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        live, state, total = np.arange(len(words)), np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            over = sizes[live] == depth
            if over.any():
                for i, s, t in zip(live[over].tolist(), state[over].tolist(), total[over].tolist(), strict=True):
                    if self.final[s]:
                        out[i] = self.run_ids[self.run_at[t] : self.run_at[t + 1]].tolist()
                live, state, total = live[~over], state[~over], total[~over]
            if not len(live):
                break
            key = state << 8 | flat[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            ok = self.arc_keys[at] == key
            live, at = live[ok], at[ok]
            state, total = self.arc_to[at].astype(np.int64), total[ok] + self.arc_add[at]
            depth += 1
        return out


def frequent_words(docs: DataFrame, size: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents. Each task keeps a summary of bounded size; the summaries are added up."""

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        seen: Counter = Counter()
        for batch in sliced(batches, limit=BATCH_BYTES):
            # Units are counted, and only the frequent of these are split into words; what is long is split at once.
            named = units(batch.column("text"))[0].dictionary_encode()
            many = np.bincount(named.indices.to_numpy(), minlength=len(named.dictionary)).tolist()
            for unit, n in zip(named.dictionary.cast(pa.string()).to_pylist(), many, strict=True):
                if len(unit) <= WORD_CHARS:
                    seen[unit] += n
                else:
                    for word in split(unit):
                        if len(word) <= WORD_CHARS:
                            seen[word] += n
            if len(seen) > 8 * SUMMARY_WORDS:
                # As in summaries of heavy hitters: what is left gives up what the first word below the bound has.
                top = seen.most_common(SUMMARY_WORDS + 1)
                floor = top[-1][1]
                seen = Counter({w: n - floor for w, n in top[:-1] if n > floor})
        words: Counter = Counter()
        for unit, n in seen.most_common(SUMMARY_WORDS):
            for word in split(unit):
                words[word] += n
        top = words.most_common(SUMMARY_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    # Written once: its histogram and its rows above the bound are two jobs.
    counts = checkpointed(docs.select("text").mapInArrow(summaries, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    return sorted(r.word for r in most_frequent(counts, size).select("word").collect())


class Codec:
    """A worker's encoder. It remembers what units become: their ids (as numbers of 32 bits, and as decimals with a comma after each) and what these decode to. A new unit is split into words, and their ids come from the transducer or from exact merges."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = regex.compile(PATTERN).findall
        cut = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, cut)) + ")").split if cut else None
        self.decimals = pa.array([b"%d," % i for i in range(len(vocabulary.tokens))], pa.binary())
        self.tokens = pa.array(vocabulary.tokens, pa.binary())
        self.memory = UnitMemory(self.learn, 3, [s.encode() for s in vocabulary.special], MEMORY_BYTES)

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self.cut is None or not any(s in text for s in self.vocabulary.special):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def learn(self, units: pa.Array) -> list[pa.Array]:
        """What the units become."""
        found = [self.pieces(u) for u in units.cast(pa.string()).to_pylist()]
        words = list(dict.fromkeys(chain.from_iterable(found)))
        raw = [w.encode() for w in words]
        runs_ = self.lexicon.find(raw)
        lost = [i for i, r in enumerate(runs_) if r is None]
        for i, ids in zip(lost, self.vocabulary.merge_many([raw[i] for i in lost]), strict=True):
            runs_[i] = ids
        of = dict(zip(words, runs_, strict=True))
        of |= {w: [i] for w, i in self.vocabulary.special.items() if w in of}
        lists = [of[w] for ws in found for w in ws]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])[np.concatenate([[0], np.cumsum([len(ws) for ws in found])])]
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]))
        out = [joined(4 * ends, ids.astype("<u4").tobytes())]
        for table in (self.decimals, self.tokens):
            data, at = runs(table.take(pa.array(ids)))
            out.append(joined(at[ends], data))
        return out

    def encode(self, texts: pa.Array) -> list[tuple[memoryview, np.ndarray]]:
        """The ids, decimals and decoded bytes of some texts one after another, each with the places where texts begin in it (one more for the end)."""
        found, first = self.memory.find(texts)
        return [(data, at[first]) for data, at in map(runs, found)]

    def rest(self) -> None:
        """Gives memory that is not in use back to the system: a worker that waits, or goes on with another job, holds no more than what it remembers."""
        pa.default_memory_pool().release_unused()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _prepared(docs: DataFrame, path: str | None):
    """What workers need, sent once: the tokenizer file and the packed lexicon (both of a size that does not follow the corpus)."""
    with open(path or default_path(), "rb") as f:
        blob = f.read()
    vocabulary = Vocabulary(blob)
    words = [w.encode() for w in frequent_words(docs)]
    lexicon = Transducer.build(dict(zip(words, vocabulary.merge_many(words), strict=True)))
    packed, index = lexicon.pack()
    key = hashlib.sha256(blob + packed + repr(index).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((key, blob, packed, index))


#: The codec of a worker that is used again, by the digest of what it is made of.
_codecs: dict[str, Codec] = {}


def _codec(sent) -> Codec:
    key, blob, packed, index = sent.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(blob), Transducer.mapped(packed, index))
    return _codecs[key]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): the token ids of every whole text."""
    sent = _prepared(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in sliced(batches, limit=BATCH_BYTES):
            (data, at), *_ = codec.encode(batch.column("text"))
            ids = pa.ListArray.from_arrays(pa.array(at // 4, pa.int32()), pa.array(np.frombuffer(data, "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])
        codec.rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the texts of token ids."""
    with open(path or default_path(), "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary(sent.value), Transducer.build({}))
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded in one pass."""
    sent = _prepared(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in sliced(batches, limit=BATCH_BYTES):
            (_, places), (decimals, at), (decoded, of) = codec.encode(batch.column("text"))
            counts = np.diff(places) // 4
            # The comma after a text's last id is left out.
            ids_sha = [hashlib.sha256(decimals[a : max(a, b - 1)]).hexdigest() for a, b in pairwise(at.tolist())]
            text_sha = [hashlib.sha256(str(decoded[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in pairwise(of.tolist())]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
