"""An adaptive arithmetic coder of ids: predictions of order 2, 1 and 0 are mixed, and many blocks are coded side by side.

Every block starts from nothing: its own ids in ascending order are numbered (symbols), and the models know no more than what
the block has shown so far. Order 2 and order 1 each predict the symbol that last came after the last two symbols or the last
one; order 0 is the distribution of the symbols so far. The probability of a symbol is the mixture of the three, with weights
learnt for each state of the two predictions (how often each was right in a row).

A block is cut into eight streams of equal length that are coded side by side and share the block's models; so one step codes
eight symbols of each block. The models are brought up to date at set places of the streams: the predictions at each of
`_PLACES`, order 0 and the weights at those of `_PLAN`. A range coder of 48 bits with words of 24 bits writes each stream; a carry is
added to the words before at the end. The code of a block is the number of words of each stream (16 bits each) and these
words. A block with one distinct id needs no code.

All numbers are integers, so every machine codes alike (quotients are below 2**18 of numbers below 2**48, which doubles hold).
One step codes the next symbol of all streams at once (lanes of arrays); what the coder knows ahead is computed for many steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ids of a block, at most: symbols fit in 12 bits.
BLOCK_IDS = 4096
#: Blocks coded side by side, at most, and streams of each.
LANES, STREAMS = 512, 8
_STEPS = BLOCK_IDS // STREAMS
#: Places of the streams at which predictions are brought up to date, and those at which order 0 and the weights are too.
_PLACES = tuple(sorted({k // STREAMS for k in (0, 64, *range(128, BLOCK_IDS, 128))}))
_PLAN = frozenset(k // STREAMS for k in (0, 64, 128, 256, 512, 1024, 2048, 3072))
#: Cells of the order-2 table of a block. Numbers in arrays, as these cost a call less than Python's.
_CELLS = 2048
_TWO, _THREE, _LOW_CELLS, _MUL = np.array(2, np.int16), np.array(3, np.int16), np.array(_CELLS - 1), np.array(167)
_S2, _F15, _S15 = np.array(2), np.array((1 << 15) - 1, np.int32), np.array(15, np.int32)
#: What the weights begin with: a prediction that was right three times in a row is trusted before its state was seen.
_FIRST = np.array([(t, o, 1 if t or o else 0, 0) for t in (0, 0, 3, 15) for o in (0, 0, 3, 15)], np.int64)
#: All parts of a mixture together; a word; a span below 2**24 gives up a word.
_BITS = 18
_ALL, _SHIFT, _WORD, _W24 = 1 << _BITS, np.array(_BITS), np.array((1 << 24) - 1), np.array(24)
_LEAST, _ONE, _ZERO = np.array(1 << 24), np.array(1), np.array(0)


def _follow(table: np.ndarray, place: np.ndarray, old: np.ndarray, fresh: np.ndarray) -> None:
    """What came last after each context, and in two bits how often in a row that was foretold; of equal contexts the last counts."""
    table[place.reshape(-1)] = (fresh + np.int16(1) + np.minimum(old & _THREE, _TWO) * ((old ^ fresh) < 4).view(np.int8)).reshape(-1)


class _Lanes:
    """The models of blocks, and the streams of these in order of falling length. sizes: symbols to code; alphabets: symbols that each block has."""

    def __init__(self, sizes: np.ndarray, alphabets: np.ndarray):
        self.d = alphabets.astype(np.int64)
        self.n, self.wide = len(sizes), int(alphabets.max())
        long = -(-sizes // STREAMS)
        begin = np.arange(STREAMS) * long[:, None]
        length = np.clip(sizes[:, None] - begin, 0, long[:, None]).reshape(-1)
        # A block's streams keep their order, since their length falls.
        self.order = np.argsort(-length, kind="stable")[: int((length > 0).sum())]
        self.sizes, self.block = length[self.order], self.order // STREAMS
        #: Where each stream begins in rows of all blocks' symbols.
        self.width = int(sizes.max())
        self.begin = begin.reshape(-1)[self.order] + self.block * self.width
        # Order 0 has four cells for each symbol, 4,096 at least.
        self.bits = np.maximum(12, 2 + np.ceil(np.log2(np.maximum(self.d, 2))).astype(np.int64))
        self.seen = np.zeros((self.n, self.wide), np.int32)
        self.before = np.zeros((self.n, self.wide + 1), np.int32)
        #: Of each block's symbol, the first of its cells and in 15 bits how many it has.
        self.cells = np.zeros(self.n * self.wide, np.int32)
        self.t1, self.t2 = np.zeros(self.n * self.wide, np.int16), np.zeros(self.n * _CELLS, np.int16)
        # Of each block and state: how often order 2, order 1 and neither was right; where the parts of order 1 and 0 start, and what a cell of order 0 has.
        self.right = np.tile(_FIRST, (self.n, 1))
        self.news: list[tuple[np.ndarray, np.ndarray]] = []

    def runs(self) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """Runs of steps (first, end) within which no model is brought up to date, how many lanes have a symbol at their start, and which have at each step (nothing if all)."""
        steps = int(self.sizes[0])
        for a, b in zip(_PLACES, (*_PLACES[1:], _STEPS), strict=True):
            if a < steps:
                if a in _PLAN:
                    self.refresh()
                b, live = min(b, steps), int(np.searchsorted(-self.sizes, -a, side="left"))
                yield a, b, live, None if self.sizes[live - 1] >= b else np.arange(a, b)[:, None] < self.sizes[:live]

    def learn(self, x: np.ndarray, told: np.ndarray, c1: np.ndarray, e1: np.ndarray, c2: np.ndarray, e2: np.ndarray, there: np.ndarray | None) -> None:
        """The predictions as of the end of a run; its symbols and which part of which state foretold each are kept for order 0 and the weights."""
        places = x + (self.block * self.wide)[: x.shape[1]]
        if there is not None:
            x, told, c1, e1, c2, e2, places = (v[there] for v in (x, told, c1, e1, c2, e2, places))
        fresh = x << _TWO
        _follow(self.t1, c1, e1, fresh)
        _follow(self.t2, c2, e2, fresh)
        self.news.append((places.reshape(-1), told.reshape(-1).copy()))

    def refresh(self) -> None:
        """Order 0 and the weights as of now: each symbol has one cell, and the others by its number so far."""
        if self.news:
            places, told = (np.concatenate(v) for v in zip(*self.news, strict=True))
            self.seen += np.bincount(places, minlength=self.seen.size).reshape(self.n, -1)
            self.right += np.bincount(told, minlength=self.right.size).reshape(-1, 4)
        self.news = []
        # Before any symbol was seen all have the same share.
        k = np.minimum(np.arange(1, self.wide + 1, dtype=np.int32), self.d[:, None].astype(np.int32))
        total = np.cumsum(self.seen, axis=1, dtype=np.int32)
        if not total[:, -1].all():
            total = k
        # A quarter more, so that all of the symbols have all of the cells.
        scale = ((np.int64(1) << self.bits) - self.d + 0.25) / total[:, -1]
        np.add((total * scale[:, None]).astype(np.int32), k, out=self.before[:, 1:])
        self.cells = ((self.before[:, :-1] << 15) + np.diff(self.before, axis=1)).reshape(-1)
        two, one, none, _ = self.right.T
        bits = np.repeat(self.bits, 16)
        p2 = np.clip((2 * two + 1) * (_ALL // 2) // (two + one + none + 2), 256, _ALL - (1 << bits) - 1024)
        p1 = np.clip((2 * one + 1) * (_ALL // 2) // (one + none + 2), 1 << 13, _ALL - (1 << 14))
        # Each cell of order 0 has a whole part; what is left over is added to order 1.
        self.cell = np.maximum((_ALL - p2 - (((_ALL - p2) * p1) >> _BITS)) >> bits, 1)
        self.first, self.zero = p2, _ALL - (self.cell << bits)


def _coded(blocks: np.ndarray, sizes: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all streams, block by block, and how many each has (block by stream)."""
    lanes = _Lanes(sizes, alphabets)
    n, wide = len(lanes.order), lanes.wide
    # A step writes one word at most, and at the end one follows.
    row = int(lanes.sizes[0]) + 2
    words = np.zeros(n * row, np.int32)
    all_low, all_span, all_at = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64), np.arange(n) * row
    last, second = np.zeros(n, np.int16), np.zeros(n, np.int16)
    for first, end, live, there in lanes.runs():
        block = lanes.block[:live]
        x = blocks.take(lanes.begin[:live] + np.arange(first, end)[:, None], mode="clip")
        if there is not None:
            x[~there] = 0
        seq = np.concatenate([second[None, :live], last[None, :live], x]).astype(np.int64)
        second[:live], last[:live] = seq[-2], seq[-1]
        c1 = seq[1:-1] + block * wide
        c2 = ((seq[:-2] * 167 + seq[1:-1]) & _LOW_CELLS) + block * _CELLS
        e1, e2 = lanes.t1.take(c1), lanes.t2.take(c2)
        fresh = x << _TWO
        kind = ((e2 ^ fresh) >= 4).view(np.int8) * (np.int8(1) + ((e1 ^ fresh) >= 4).view(np.int8))
        state = ((e2 & _THREE) << _TWO | (e1 & _THREE)) + block * 16
        p2, zero, cell = lanes.first.take(state), lanes.zero.take(state), lanes.cell.take(state)
        own = lanes.cells.take(seq[2:] + block * wide)
        literal, other = kind == 2, kind == 1
        offs = np.where(literal, zero + cell * (own >> 15), p2 * other)
        parts = np.where(literal, cell * (own & _F15), np.where(other, zero - p2, p2))
        lanes.learn(x, state * 4 + kind, c1, e1, c2, e2, there)
        ends = [first, *np.unique(lanes.sizes[:live][lanes.sizes[:live] < end]).tolist(), end] if there is not None else [first, end]
        for a, b in zip(ends, ends[1:], strict=False):
            now = int(np.searchsorted(-lanes.sizes, -a, side="left"))
            low, span, at = all_low[:now], all_span[:now], all_at[:now]
            r = np.empty(now, np.int64)
            for off, part in zip(offs[a - first : b - first, :now], parts[a - first : b - first, :now], strict=True):
                np.right_shift(span, _SHIFT, r)
                np.multiply(r, part, span)
                np.multiply(r, off, r)
                np.add(low, r, low)
                words[at] = low >> _W24
                m = (span < _LEAST).astype(np.int64)
                np.add(at, m, at)
                np.subtract(m, _ONE, r)
                np.bitwise_or(r, _WORD, r)
                np.bitwise_and(low, r, low)
                np.multiply(m, _W24, m)
                np.left_shift(low, m, low)
                np.left_shift(span, m, span)
    # A span of 2**24 holds a number whose last word is nothing.
    words[all_at] = (all_low + _WORD) >> _W24
    many = np.zeros(lanes.n * STREAMS, np.int64)
    many[lanes.order] = all_at - np.arange(n) * row + 1
    out = words.reshape(n, row)[:, : int(many.max())]
    while (carry := out >> 24).any():
        out &= _WORD.astype(np.int32)
        out[:, :-1] += carry[:, 1:]
    ordered = out[np.argsort(lanes.order)]
    return ordered[np.arange(out.shape[1]) < many[many > 0][:, None]], many.reshape(-1, STREAMS)


def encode_blocks(symbols: np.ndarray, sizes: np.ndarray, alphabets: np.ndarray) -> list[bytes]:
    """The code of each block. symbols: step by lane; lanes in order of falling size."""
    out = [b""] * len(sizes)
    rest = np.flatnonzero(alphabets > 1)
    if len(rest):
        sizes = np.asarray(sizes)[rest]
        words, many = _coded(np.ascontiguousarray(symbols[: int(sizes.max())].T[rest]), sizes, np.asarray(alphabets)[rest])
        raw, heads = words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), many.astype("<u2")
        ends = (3 * np.cumsum(many.sum(axis=1))).tolist()
        for i, head, a, b in zip(rest.tolist(), heads, [0, *ends], ends, strict=False):
            out[i] = head.tobytes() + raw[a:b]
    return out


def decode_blocks(codes: list[bytes], sizes: np.ndarray, alphabets: np.ndarray) -> np.ndarray:
    """The symbols, step by lane, of blocks in order of falling size."""
    out = np.zeros((len(codes), int(np.max(sizes))), np.int16)
    rest = np.flatnonzero(alphabets > 1)
    if len(rest):
        sizes = np.asarray(sizes)[rest]
        out[rest, : int(sizes.max())] = _decoded([codes[i] for i in rest], sizes, np.asarray(alphabets)[rest])
    return out.T


def _decoded(codes: list[bytes], sizes: np.ndarray, alphabets: np.ndarray) -> np.ndarray:
    """The symbols, block by step."""
    lanes = _Lanes(sizes, alphabets)
    n, wide = len(lanes.order), lanes.wide
    head = 2 * STREAMS
    many = np.frombuffer(b"".join(c[:head] for c in codes), "<u2").astype(np.int64)
    raw = np.frombuffer(b"".join(c[head:] for c in codes), np.uint8).reshape(-1, 3).astype(np.int64)
    # After each stream stand two words of nothing: the coder leaves out the last one, and a step looks one ahead.
    words = np.zeros(len(raw) + 2 * len(many), np.int64)
    words[np.arange(len(raw)) + np.repeat(2 * np.arange(len(many)), many)] = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    all_at = (np.cumsum(many) - many + 2 * np.arange(len(many)))[lanes.order]
    all_code, all_span = words[all_at] << 24 | words[all_at + 1], np.full(n, 1 << 48, np.int64)
    all_at += 2
    out = np.zeros((lanes.n, lanes.width), np.int16)
    t1, t2 = lanes.t1, lanes.t2
    # The symbol of each cell of order 0.
    size = np.int64(1) << lanes.bits
    cells = int(size.max())
    of_cell = np.zeros((lanes.n, cells), np.int16)
    within = None if (size == cells).all() else np.arange(cells) < size[:, None]
    symbol_of = of_cell.reshape(-1)
    numbers = np.tile(np.arange(wide, dtype=np.int16), lanes.n)
    all_last, all_second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows1, rows2, rows_c, rows_s, all_lanes = lanes.block * wide, lanes.block * _CELLS, lanes.block * cells, lanes.block * 16, np.arange(n)
    for first, end, live, there in lanes.runs():
        if first in _PLAN:
            run = np.repeat(numbers, np.diff(lanes.before, axis=1).reshape(-1))
            if within is None:
                symbol_of[:] = run
            else:
                of_cell[within] = run
        own_cells, of_first, of_zero, of_one = lanes.cells, lanes.first, lanes.zero, lanes.cell
        xs, all_e1, all_e2 = (np.zeros((end - first, live), np.int16) for _ in range(3))
        all_c1, all_c2, told = (np.zeros((end - first, live), np.int64) for _ in range(3))
        ends = [first, *np.unique(lanes.sizes[:live][lanes.sizes[:live] < end]).tolist(), end] if there is not None else [first, end]
        for a, b in zip(ends, ends[1:], strict=False):
            now = int(np.searchsorted(-lanes.sizes, -a, side="left"))
            code, span, at, row1, row2, row_c, row_s, lane = (v[:now] for v in (all_code, all_span, all_at, rows1, rows2, rows_c, rows_s, all_lanes))
            last, second = all_last[:now].copy(), all_second[:now].copy()
            p2, s3, cell, r, t, g, f, state = (np.empty(now, np.int64) for _ in range(8))
            own = np.empty(now, np.int32)
            s16, low16, quotient = np.empty(now, np.int16), np.empty(now, np.int16), np.empty(now)
            # Of order 2, 1 and 0: where their part starts, what the symbol has of it, and the symbol.
            starts, shares, symbols = np.zeros((3, now), np.int64), np.empty((3, now), np.int64), np.empty((3, now), np.int16)
            count, (share2, share1, share0), (x2, x1, x0) = np.array(now), shares, symbols
            _, start1, start0 = starts
            for k in range(a - first, b - first):
                c1, c2, e1, e2, x, tell = all_c1[k, :now], all_c2[k, :now], all_e1[k, :now], all_e2[k, :now], xs[k, :now], told[k, :now]
                np.add(last, row1, c1)
                np.multiply(second, _MUL, c2)
                np.add(c2, last, c2)
                np.bitwise_and(c2, _LOW_CELLS, c2)
                np.add(c2, row2, c2)
                t1.take(c1, None, e1, "clip")
                t2.take(c2, None, e2, "clip")
                np.bitwise_and(e2, _THREE, s16)
                np.left_shift(s16, _TWO, s16)
                np.bitwise_and(e1, _THREE, low16)
                np.bitwise_or(s16, low16, s16)
                np.add(row_s, s16, state)
                of_first.take(state, None, p2, "clip")
                of_zero.take(state, None, s3, "clip")
                of_one.take(state, None, cell, "clip")
                np.right_shift(span, _SHIFT, r)
                np.multiply(r, p2, start1)
                np.multiply(r, s3, s3)
                np.multiply(r, cell, cell)
                np.subtract(code, s3, t)
                np.divide(t, cell, quotient)
                np.add(quotient.astype(np.int64), row_c, g)
                symbol_of.take(g, None, x0, "clip")
                np.add(row1, x0, g)
                own_cells.take(g, None, own, "clip")
                np.multiply(cell, own & _F15, share0)
                np.multiply(cell, own >> _S15, f)
                np.add(s3, f, start0)
                np.copyto(share2, start1)
                np.subtract(s3, start1, share1)
                np.right_shift(e2, _TWO, x2)
                np.right_shift(e1, _TWO, x1)
                kind = ((code >= start1).view(np.int8) + (t >= _ZERO).view(np.int8)).astype(np.int64)
                np.left_shift(state, _S2, tell)
                np.add(tell, kind, tell)
                np.multiply(kind, count, kind)
                np.add(kind, lane, kind)
                symbols.take(kind, None, x, "clip")
                starts.take(kind, None, g, "clip")
                shares.take(kind, None, span, "clip")
                np.subtract(code, g, code)
                m = (span < _LEAST).astype(np.int64)
                words.take(at, None, g, "clip")
                np.add(at, m, at)
                np.multiply(m, _W24, m)
                np.left_shift(span, m, span)
                np.left_shift(code, m, code)
                np.subtract(_W24, m, m)
                np.right_shift(g, m, g)
                np.bitwise_or(code, g, code)
                second, last = last, x.astype(np.int64)
            all_last[:now], all_second[:now] = last, second
        places = lanes.begin[:live] + np.arange(first, end)[:, None]
        if there is None:
            out.reshape(-1)[places] = xs
        else:
            out.reshape(-1)[places[there]] = xs[there]
        lanes.learn(xs, told, all_c1, all_e1, all_c2, all_e2, there)
    return out
