"""Periodic runs against brute force, coded token ids against the library, whitening against a dense eigensolver."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from formlake.llm import contour, id_coder, periodic_runs, token_output, whitening
from formlake.llm.token_codec import default_path


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and not any(all(w[t] == w[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        docs = [[x for _ in range(rng.randint(0, 5)) for x in ([rng.randint(0, 2) for _ in range(rng.randint(1, 14))] * 12)[: rng.randint(0, 90)]] for _ in range(rng.randint(0, 6))]
        got = periodic_runs.runs_of(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d)]


def test_run_summaries(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", "a " * 24, "a " * 23, "x " + "a b c " * 9 + "a", "b " * 30 + "a " * 30, f"{long} {long} {long}", "u\n\tv " * 12 + "z", "a b " * 12 + "c d " * 12]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a " * 50, None, None), (2, "a " * 24, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, words int")
    got = sorted(map(tuple, periodic_runs.summaries(docs).collect()), key=repr)
    expected, runs_expected = [], []
    for i, t, *_ in rows:
        w = (t or "").split()
        runs = [(0, 90_000, 30_000)] if len(w) == 90_000 else brute_runs(w)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        runs_expected += [(i, *r) for r in runs]
    assert got == sorted(expected, key=repr)
    assert sorted(map(tuple, periodic_runs.find_runs(docs).collect()), key=repr) == sorted(runs_expected, key=repr)
    assert {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).filter("doc_id = 4").collect()} == {4: "x a b c"}
    assert periodic_runs.summaries(docs.limit(0)).count() == 0


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    for blocks in ([np.zeros(1, int)], [np.arange(4096), np.zeros(4096, int), np.array([0, 1] * 900), rng.integers(0, 500, 4000)], [np.minimum(rng.zipf(1.3, n), 400) for n in (700, 650, 3, 1)]):
        blocks = sorted(blocks, key=len, reverse=True)
        sizes, alphabets = np.array([len(b) for b in blocks]), np.array([b.max() + 1 for b in blocks])
        symbols = np.zeros((sizes.max(), len(blocks)), np.int16)
        for i, b in enumerate(blocks):
            symbols[: len(b), i] = b
        codes = id_coder.encode_blocks(symbols, sizes, alphabets)
        got = id_coder.decode_blocks(codes, sizes, alphabets)
        assert all((got[: len(b), i] == b).all() for i, b in enumerate(blocks))
    # What repeats costs little, what has one shape for all less than its plain bits.
    assert len(id_coder.encode_blocks(np.zeros((4096, 1), np.int16), np.array([4096]), np.array([1]))[0]) < 100
    assert len(id_coder.encode_blocks(np.tile(np.arange(16, dtype=np.int16), 256)[:, None], np.array([4096]), np.array([16]))[0]) < 300


def test_coder_codes_eight_symbols_of_a_block_at_once():
    assert id_coder._Lanes(np.array([4096]), np.array([5])).sizes.tolist() == [512] * 8
    rng = np.random.default_rng(3)
    sizes = np.sort(np.concatenate([np.arange(1, 40), rng.integers(1, 4097, 30), [4096, 4095, 4089, 4088, 513, 512]]))[::-1]
    blocks = [np.minimum(rng.zipf(1.2, n), rng.integers(1, 4096)) - 1 if n % 3 else np.resize(rng.integers(0, 60, 90), n) for n in sizes]
    alphabets = np.array([b.max() + 1 for b in blocks])
    symbols = np.zeros((sizes.max(), len(blocks)), np.int16)
    for i, b in enumerate(blocks):
        symbols[: len(b), i] = b
    codes = id_coder.encode_blocks(symbols, sizes, alphabets)
    # The code of a block depends on no other block that is coded beside it.
    for own in (range(len(blocks)), range(0, len(blocks), 2), *([i] for i in range(len(blocks)))):
        own = list(own)
        assert id_coder.encode_blocks(symbols[:, own], sizes[own], alphabets[own]) == [codes[i] for i in own]
        got = id_coder.decode_blocks([codes[i] for i in own], sizes[own], alphabets[own])
        assert all((got[: len(blocks[i]), k] == blocks[i]).all() for k, i in enumerate(own))


def test_blocks_name_damage():
    segments = np.array([(5, 3, 4000), (0, 7, 5000)], token_output._SEGMENT)
    ids = np.random.default_rng(2).integers(0, 2**32 - 1, 9000, dtype=np.uint32)
    blocks = token_output.pack_blocks(ids, segments)
    got, marks = token_output.unpack_blocks(blocks)
    assert (np.concatenate(got) == ids).all() and [m.tolist() for m in marks] == [[(5, 3, 4000), (0, 5, 96)], [(0, 4, 4096)], [(0, 6, 808)]]
    # Each block is read by itself.
    assert (token_output.unpack_blocks(blocks[1:2])[0][0] == ids[4096:8192]).all()
    for at in (10, len(blocks[0]) // 2, len(blocks[0]) - 1):
        broken = bytearray(blocks[0])
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            token_output.unpack_blocks([bytes(broken)])


def test_token_output_equals_library(spark, tmp_path):
    library = Tokenizer.from_file(default_path())
    long = " ".join(f"w{i % 977} </s> x" for i in range(9000))
    rows = [(5, "a"), (None, "null id"), (3, None), (4, ""), (9, long), (9, "short"), (9, "short"), (-7, "  two  \n\n blanks\t "), (10, f"{long} end <s>é　 漢字")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, first string")
    token_output.write_ids(docs, f"{tmp_path}/ids")
    got = sorted(map(tuple, token_output.checksums(spark, f"{tmp_path}/ids").collect()), key=lambda r: r[1])
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((g[0], g[2], g[3]) for g in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in ids), key=repr)
    assert [g[0] for g in got] == [None, -7, 3, 4, 5, 9, 9, 9, 10]
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    segments = token_output.read_ids(spark, f"{tmp_path}/ids").filter("doc_id = 10").orderBy("first").collect()
    assert sum((r.ids for r in segments), []) == ids[-1][1] and len(segments) > 10 and segments[0].begins and segments[-1].ends
    token_output.write_ids(docs.limit(0), f"{tmp_path}/none")
    assert token_output.checksums(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("spectrum", [[5.0], [3, 1], [9, 7, 7, 7, 1, 0], [4] * 8, [1, 1e-9] + [0] * 8, [100, 50, 25, 12] + [1] * 30, list(np.linspace(10, 1, 40)), list(1 + 1e-6 * np.arange(20)), list(1 + 5e-3 * np.random.default_rng(1).random(64)), list(1 + 1e-9 * np.random.default_rng(1).random(64))])
def test_contour_equals_dense(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum),) * 2))
    a = (q * np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, vectors = contour.top_pairs(a, 4)
    dense = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, dense[:4], atol=1e-12 * max(spectrum)) and np.abs(a @ vectors - vectors * values).max() < 1e-13 * max(spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert all(contour.count_above(a, s) == (dense > s).sum() for s in (0.5, 2.5, 6.9))


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 12)) * np.arange(1, 13)
    rows = [(i, [float(c) for c in v], 0.5) for i, v in enumerate(x)]
    odd = [(300, None), (301, [1.0, None] * 6), (302, [float("nan")] * 12), (303, [float("-inf")] * 12), (304, rows[0][1]), (304, rows[0][1]), (305, [1.0]), (306, []), (None, rows[1][1])]
    vectors = spark.createDataFrame(rows + [(*r, None) for r in odd], "vec_id long, embedding array<double>, whitened double")
    got = whitening.whiten(vectors).toPandas()
    known = [(i, v + [0.0] * (12 - len(v))) for i, v, *_ in rows + odd if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    full = np.floor(256 * np.array([v for _, v in known])).astype(np.int64)
    fit = np.unique(full, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    white, dev = (full - sums / n) @ u / np.sqrt(e), ((n * full - sums) ** 2).sum(axis=1)
    assert len(got) == 4 * len(known) and set(got.n) == {n} and got.identity_error.max() < 1e-10
    for k in range(4):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, e[k] / np.trace(y.T @ y / n), rtol=1e-12)
        left = sorted((str(int(i)) if i == i else "None", int(d), round(abs(w), 9)) for i, d, w in zip(own.vec_id, own.deviation, own.whitened, strict=True))
        assert left == sorted((str(i), int(d), round(abs(w), 9)) for (i, _), d, w in zip(known, dev, white[:, k], strict=True))
    assert whitening.whiten(vectors.limit(0)).count() == 0 and whitening.whiten(vectors.filter("vec_id = 304")).count() == 0
    # Beyond the range of a long the deviation is null.
    huge = spark.createDataFrame([(1, [1e13, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
