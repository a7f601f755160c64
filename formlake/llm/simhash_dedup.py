"""Near-duplicates by SimHash: fingerprints linked within a Hamming radius, found by the generalised pigeonhole principle.

Bits that go together are grouped into partitions. Thresholds t_i with sum(t_i) = radius - partitions + 1 (a partition may
have -1: never probed) guarantee that two fingerprints within the radius are within t_i bits in some partition i; they are
allocated by dynamic programming on estimated candidate counts. Equal fingerprints are one class first. A bucket of classes
that is too large for a task is split again, exactly, by the same principle over its other bits, so no bucket is unbounded and
no pair is lost; within a bucket a search emits a least spanning forest of the links, not the pairs.

Null and empty texts have the fingerprint 0 and are linked like any other. Repeated rows are copies (a doc_id twice gives two
rows; rows of one doc_id are one document and stay or go together). A document without a doc_id names no group: it takes its
class's component, null if the class has no doc_id, and is never dropped. Very long texts are fingerprinted whole. A bit that
exactly half of the hashes have is 0; of equally near members any joins a forest first, which changes no component. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.components import components
from formlake.llm.durable import checkpointed
from formlake.llm.kernels import chunks
from formlake.llm.prefix_join import PAIR_ROWS, PLACE_ROWS, TEXT_ROWS, apart, common_shingles, likely_pairs, open_pairs, profiles, similar_links, stars

BITS = 64
#: Rows of a bucket that one task compares; buckets beyond it are split by further bits.
BUCKET_ROWS = 16384
#: The cost of a comparison within a bucket, in signatures.
COMPARE_COST = 0.002


def fingerprint_batch(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: words of the lower-cased text (A-Z only), shingles with repeats, XXH64; a bit is set if over half the hashes have it."""
    digest = xxhash.xxh64_digest
    hashes, counts = [], []
    for text in texts:
        found = text.lower().split()
        if len(found) >= words:
            rows = [digest(b" ".join(s), seed) for s in zip(*(found[i:] for i in range(words)), strict=False)]
        else:
            rows = [digest(b" ".join(found), seed)] if found else []
        hashes += rows
        counts.append(len(rows))
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array(counts, np.int64)
    full = np.flatnonzero(sizes)
    if full.size:
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, BITS)
        first = (np.cumsum(sizes) - sizes)[full]
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > sizes[full, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fingerprint_batch(texts, words).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: their number, and how many have bits i and j both set (64 x 64)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 4096):
                bits = _bits(fp[at : at + 4096]).astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([[n, *total.astype(np.int64).ravel().tolist()]], pa.list_(pa.int64()))], ["x"])

    sums = classes.select("fp").mapInArrow(run, "x array<long>").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + BITS * BITS)
    for r in sums:
        flat[r.i] = r.v
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    """Bit b of each number in column b."""
    return (fp[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly one size: a group starts with the pair that goes together most and takes the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = tie[np.ix_(free, free)]
        seed = free[int(own.sum(axis=1).argmax())]
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = free[int(tie[np.ix_(free, group)].sum(axis=1).argmax())]
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _near(differ: np.ndarray) -> np.ndarray:
    """P(distance <= t) for t = 0, 1, ... where bit i differs with probability differ[i]."""
    dist = np.zeros(len(differ) + 1)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return np.cumsum(dist)


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated cost (signatures and candidates) that the pigeonhole principle allows."""
    p = np.diag(both) / max(n, 1)
    costs = []
    for g in groups:
        near = _near(2 * p[g] * (1 - p[g]))
        costs.append([0.0] + [n * sum(comb(len(g), j) for j in range(t + 1)) + COMPARE_COST * n * n / 2 * near[min(t, len(g))] for t in range(radius + 1)])
    need = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                if s + t not in step or c + cost[t + 1] < step[s + t][0]:
                    step[s + t] = (c + cost[t + 1], [*ts, t])
        best = step
    return best[need]


def plan(n: int, both: np.ndarray, radius: int) -> list[tuple[int, int, list[int]]]:
    """(mask of a partition, its threshold, its bits) of the cheapest plan over numbers of partitions; partitions never probed are left out."""
    found = []
    for parts in range(2, radius + 2):
        groups = group_bits(n, both, parts)
        found.append((*allocate(n, both, groups, radius), groups))
    if not found:
        found.append((0.0, [0], [list(range(BITS))]))
    _, ts, groups = min(found, key=lambda x: x[0])
    return [(_signed(sum(1 << b for b in g)), t, g) for t, g in zip(ts, groups, strict=True) if t >= 0]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _linked(fp: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Members of a bucket that have a link in it."""
    out = np.zeros(len(fp), bool)
    for at in range(0, len(fp), 128):
        near = np.bitwise_count(fp[at : at + 128, None] ^ fp[None, at:]) <= radius
        near &= home[at : at + 128, None] | home[None, at:]
        k = np.arange(len(near))
        near[k, k] = False
        out[at:] |= near.any(axis=0)
        out[at : at + 128] |= near.any(axis=1)
    return np.flatnonzero(out)


def _search(fp: np.ndarray, ids: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A least spanning forest of the links in one bucket: the nearest member joins next, so no link is replaced by a wider one. At least one of a linked pair is at home in the bucket."""
    some = _linked(fp, home, radius)
    fp, ids, home = fp[some], ids[some], home[some]
    out = []
    open_ = np.arange(len(fp))
    gap, by = np.full(len(fp), BITS + 1, np.uint8), np.zeros(len(fp), np.int64)
    while len(open_):
        k = int(gap[open_].argmin())
        i = int(open_[k])
        if gap[i] <= radius:
            out.append((int(ids[by[i]]), int(ids[i])))
        open_ = np.delete(open_, k)
        new = np.bitwise_count(fp[open_] ^ fp[i])
        if not home[i]:
            new[~home[open_]] = BITS + 1
        less = new < gap[open_]
        gap[open_[less]], by[open_[less]] = new[less], i
    return out


def _links_of(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("rows")
        flat = rows.flatten()
        fp = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        ids = flat.field("rep").to_numpy(zero_copy_only=False)
        home = flat.field("home").to_numpy(zero_copy_only=False)
        ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
        found: list[tuple[int, int]] = []
        sizes = np.diff(ends, prepend=0)
        pair = np.flatnonzero(sizes == 2)
        a = ends[pair] - 2
        hit = a[(np.bitwise_count(fp[a] ^ fp[a + 1]) <= radius) & (home[a] | home[a + 1])]
        for k in np.flatnonzero(sizes > 2):
            x, y = ends[k] - sizes[k], ends[k]
            found += _search(fp[x:y], ids[x:y], home[x:y], radius)
        left, right = [x for x, _ in found], [y for _, y in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[hit], np.array(left, np.int64)])), pa.array(np.concatenate([ids[hit + 1], np.array(right, np.int64)]))], ["a", "b"])


def _signature(part: int, mask: int, flip: Column, home: bool) -> Column:
    """The bucket of a fingerprint, some bits flipped, in a partition of bits."""
    return F.struct(F.lit(part).cast("long").alias("part"), F.col("fp").bitwiseXOR(flip.cast("long")).bitwiseAND(F.lit(mask).cast("long")).alias("key"), F.lit(home).alias("home"))


def links(classes: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """a, b: links between representatives (rep) of fingerprint classes (fp), enough to connect all within the radius."""
    classes = classes.filter("rep is not null")
    n, both = bit_statistics(classes)
    chosen = plan(n, both, radius)
    cases = []
    for i, (mask, t, bits) in enumerate(chosen):
        flips = [_signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in combinations(bits, k)]
        home = F.array(_signature(i, mask, F.lit(0).cast("long"), True))
        probes = [F.transform(F.array(*map(F.lit, flips)), lambda x: _signature(i, mask, x, False))] if flips else []  # noqa: B023  called at once
        cases.append(F.concat(home, *probes))
    rows = classes.select("fp", "rep", F.explode(F.concat(*cases)).alias("s")).select("s.part", "s.key", "s.home", "fp", "rep")
    masks = {i: mask & ((1 << 64) - 1) for i, (mask, _, _) in enumerate(chosen)}
    out = None
    while True:
        crowded = checkpointed(rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("part", "key"))
        parts = [r.part for r in crowded.select("part").distinct().collect()]  # one number for each partition of bits, at most
        some = [p for p in parts if BITS - masks[p].bit_count() > (bucket_rows - 1).bit_length()]
        light = rows if not some else rows.join(crowded.filter(F.col("part").isin(some)), ["part", "key"], "left_anti")
        buckets = light.groupBy("part", "key").agg(F.collect_list(F.struct("fp", "rep", "home")).alias("rows")).filter(F.size("rows") > 1).select("rows")
        own = buckets.mapInArrow(lambda batches: _links_of(batches, radius), "a long, b long")
        out = own if out is None else out.unionByName(own)
        if not some:
            return out
        # Of a crowded bucket's members, two within the radius agree on one of radius + 1 blocks of the other bits.
        step, below = {}, {}
        for p in some:
            rest = [b for b in range(BITS) if not masks[p] >> b & 1]
            blocks = [sum(1 << b for b in rest[j :: radius + 1]) for j in range(radius + 1)]
            step[p] = blocks
            below |= {p * (radius + 2) + j + 1000: masks[p] | x for j, x in enumerate(blocks)}
        deep = rows.join(crowded.filter(F.col("part").isin(some)), ["part", "key"])
        table = F.create_map(*[y for p, blocks in step.items() for y in (F.lit(p).cast("long"), F.array(*[F.lit(_signed(x)) for x in blocks]))])
        deep = deep.select("part", "key", "home", "fp", "rep", F.posexplode(F.element_at(table, F.col("part"))).alias("j", "block"))
        rows = checkpointed(deep.select((F.col("part") * (radius + 2) + F.col("j") + 1000).alias("part"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("block"))).alias("key"), "home", "fp", "rep"))
        masks = below


def group_near_copies(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links within the radius."""
    prints = checkpointed(fingerprints(docs, words))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes, radius))
    named = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """docs, with all their columns, without later near-copies: of documents connected by links of `similarity` or more, the one of the smallest doc_id stays.

    Texts of equal word sequences are one class. Candidates are first the links of SimHashes of the shingle sets within the
    radius, and with each text one least text of each place of its prefix (see prefix_join). Fingerprints of 64 bits cannot
    name every pair of the similarity (some are 20 bits apart), so then the texts of a place that are not connected by that
    are compared, first as many as may connect them, then all: no pair is lost. Every link is verified on whole texts.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    rows = checkpointed(profiles(known, common_shingles(known, shingle, similarity), shingle, similarity))
    classes = checkpointed(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), PLACE_ROWS)
    named = rows.select("doc_id", "k1", "k2", "n", "fp", "sketch", "coarse").join(classes, ["k1", "k2"])
    reps = checkpointed(named.filter("doc_id = rep").select("rep", "n", "fp", "sketch", "coarse").distinct(), TEXT_ROWS)
    # Rows of one doc_id are one document, also where its texts are of two classes.
    same = checkpointed(named.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct().join(reps.select(F.col("rep").alias("b")).distinct(), "b", "left_semi").select("a", "b"), PAIR_ROWS)
    # A class's least doc_id is in all its places, so the least of a place is one, and the others of the class go after it.
    places = rows.select(F.col("doc_id").alias("rep"), F.explode("places").alias("p")).select("p.place", "p.part", "rep")
    first = checkpointed(stars(places).join(reps.select("rep").distinct(), "rep", "left_semi"), PLACE_ROWS)
    tops = first.filter("rep = least").groupBy("place").agg(F.min("rep").alias("top"))
    between = first.join(tops, "place").filter("least <> top").select("place", F.col("least").alias("rep"), F.col("top").alias("least")).distinct()
    shared = first.filter("rep <> least").select("place", "rep", "least").unionByName(between)
    by_place = checkpointed(likely_pairs(shared.select(F.least("least", "rep").alias("a"), F.greatest("least", "rep").alias("b")).distinct(), reps, similarity), PAIR_ROWS)
    # Places of two texts are done with these pairs.
    wide = shared.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select("place")
    members = shared.select("place", "rep").unionByName(shared.select("place", F.col("least").alias("rep"))).join(wide, "place").distinct()
    members = checkpointed(members, PLACE_ROWS)
    prints = checkpointed(reps.groupBy("fp").agg(F.min("rep").alias("rep")), PLACE_ROWS)
    equal = reps.join(prints.select("fp", F.col("rep").alias("a")), "fp").filter("rep <> a").select("a", F.col("rep").alias("b"))
    near = links(prints, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = by_place.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(likely_pairs(equal.unionByName(near).distinct(), reps, similarity)).distinct()
    tried = checkpointed(tried, PAIR_ROWS)
    good = checkpointed(similar_links(tried, docs, shingle, similarity).unionByName(same), PAIR_ROWS)
    found = components(good)
    for forest in (True, False):
        more = open_pairs(members, reps, found, similarity, forest).unionByName(apart(by_place, found)).distinct()
        more = checkpointed(more.join(tried, ["a", "b"], "left_anti"), PAIR_ROWS)
        if not more.isEmpty():
            tried = checkpointed(tried.unionByName(more), PAIR_ROWS)
            good = checkpointed(good.unionByName(similar_links(more, docs, shingle, similarity)), PAIR_ROWS)
            found = components(good)
    kept = classes.select("rep").distinct().join(found.filter("node <> component").select(F.col("node").alias("rep")), "rep", "left_anti")
    return docs.join(kept.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
