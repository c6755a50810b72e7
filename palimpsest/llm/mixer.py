"""The bit model of op10: word codes, hashed counters, a match predictor, gated weights and their refinement, on whole arrays.

A word is written in the bits of its Huffman code; a rare one by an escape, whether a match has it, whether its text had it before (and as which), else its letters. Each code bit is predicted from what a node of the code tree has
seen: over all texts, after the same previous word, after the same topic (the most frequent of the last ``BACK`` words), and by a match, the continuation that
an earlier occurrence of the last words had. A gate (how far the match has held, how much the two hashed counters have seen) picks the
weights which add their log-odds up; a table of what came of such sums refines the probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from . import common as C

#: Previous words and topics that have contexts of their own; words that a topic looks back at.
PREVS, TOPICS, BACK = 1024, 256, 8
#: Id of no prediction; ids of RARE and above are 30 bits of rare words' hashes.
NONE, RARE = (1 << 30) - 1, 1 << 30
#: In a cell's key: the prediction is its own symbol.
OWN = (1 << 18) - 1
INPUTS, STATES, CONFS = 5, 6, 3
GATES = STATES * CONFS * CONFS
STEPS, REACH, TRUST, PRIOR = 33, 8.0, 30.0, 0.4
#: Bins of the mix from -FAR to FAR, in which both outcomes have a cost.
BINS, FAR = 1024, 14.0
#: Tokens of a text that are read at once, tokens that are in memory at once, cells whose bits teach at once, cells whose bits are in memory at once, and cells that are dealt to a lesson's steps together.
PIECE, GROUP, SLICE, BLOCK, RUN = 1 << 17, 1 << 19, 1 << 14, 1 << 14, 1 << 8
#: What sums of a task are multiplied by to be added as whole numbers, in whatever order.
UNIT = float(1 << 16)
CLASSES = 64
_U = np.uint64


def _classes() -> np.ndarray:
    """Classes of bytes in the letters' contexts; 26 is a word's start."""
    out = np.full(256, 28)
    out[97:123] = np.arange(26)
    out[48:58] = 27
    out[128:] = 29 + (np.arange(128) & 31)
    return out


_CLASS = _classes()


def packed(ids: np.ndarray) -> np.ndarray:
    """The bytes of ids, four of each."""
    return np.ascontiguousarray(ids, "<u4").view(np.uint8)


def unpacked(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view("<u4").astype(np.int32)


class Codes:
    """Huffman codes of symbols by their counts: of each symbol the tree's nodes from the root on, and the bit taken at each."""

    def __init__(self, counts: np.ndarray):
        m = len(counts)
        order = np.argsort(counts, kind="stable")
        leaf = counts[order].tolist()
        up, side, inner = np.zeros(2 * m - 1, np.int64), np.zeros(2 * m - 1, np.uint8), []
        self.zeros, self.ones = np.zeros(m - 1), np.zeros(m - 1)
        i = j = 0
        for k in range(m - 1):
            both = []
            for b in (0, 1):
                if j >= len(inner) or (i < m and leaf[i] <= inner[j]):
                    x, n = i, leaf[i]
                    i += 1
                else:
                    x, n = m + j, inner[j]
                    j += 1
                up[x], side[x] = k, b
                both.append(n)
            inner.append(sum(both))
            self.zeros[k], self.ones[k] = both
        at, live, nodes, bits = np.arange(m), np.ones(m, bool), [], []
        while live.any():
            nodes.append(np.where(live, up[at], -1))
            bits.append(side[at])
            live &= nodes[-1] != m - 2
            at = np.where(live, m + nodes[-1], 0)
        path, taken = np.empty((m, len(nodes)), np.int64), np.empty((m, len(nodes)), np.uint8)
        path[order], taken[order] = np.stack(nodes[::-1], axis=1), np.stack(bits[::-1], axis=1)
        held = path >= 0
        self.size = held.sum(axis=1)
        self.start = np.cumsum(self.size) - self.size
        node, self.bit = path[held], taken[held].astype(np.int8)
        depth = np.arange(len(self.bit)) - np.repeat(self.start, self.size)
        #: Each node's topmost node of NEAR levels, and its place under that; nodes are numbered so that those are together.
        within, near = depth % NEAR, np.ones(len(node), np.uint8)
        first = np.arange(len(node)) - within
        for k in range(NEAR - 1):
            more = within > k
            near[more] = 2 * near[more] + self.bit[first[more] + k].astype(np.uint8)
        top, place = np.zeros(m - 1, np.int32), np.ones(m - 1, np.uint8)
        top[node], place[node] = node[first], near
        by, number = np.lexsort((place, top)), np.empty(m - 1, np.int32)
        number[by] = np.arange(m - 1)
        self.zeros, self.ones, self.top, self.place, self.node = self.zeros[by], self.ones[by], number[top[by]], place[by], number[node]
        #: Symbols in the order of their codes, and each one's place there.
        bits = np.zeros((int(self.size.max()), m), np.int8)
        bits[depth, np.repeat(np.arange(m), self.size)] = self.bit
        #: Codes' first 53 bits, from the left.
        self.head = np.add.reduceat(np.where(depth < 53, self.bit.astype(np.int64) << np.maximum(52 - depth, 0), 0), self.start)
        self.ranked, self.rank = np.lexsort(bits[::-1]).astype(np.int32), np.empty(m, np.int32)
        self.rank[self.ranked] = np.arange(m)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bits the codes of two symbols begin with in common, of the first 53."""
        return 53 - np.frexp((self.head[a] ^ self.head[b]).astype(float))[1]


#: Levels of the code tree whose counters of one context are beside each other.
NEAR = 4
#: Counts are kept in a byte: exact below 16, then in eighths of a doubling.
COUNT = np.concatenate([np.arange(16), 16 * np.exp2(np.arange(1, 241) / 8)])


def in_bytes(n: np.ndarray) -> np.ndarray:
    return np.where(n < 16, n, np.clip(np.rint(15 + 8 * np.log2(np.maximum(n, 16) / 16)), 15, 255)).astype(np.uint8)


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Plain, with a zero taken off, and with a one taken off."""
    odds = lambda a, b: np.log((np.maximum(b, 0) + PRIOR) / (np.maximum(a, 0) + PRIOR))
    return np.stack([odds(n0, n1), odds(n0 - 1, n1), odds(n0, n1 - 1)]).astype(np.float32)


def letter_costs(cube: np.ndarray) -> np.ndarray:
    """log10 of each byte after two classes of bytes. cube: counts by class before last, last class, byte.

    Three bit predictors (of none, one and two bytes before) are mixed by weights that the seen counts choose, fitted to the cube with each sighting taken off.
    """
    tree = np.zeros((CLASSES * CLASSES, 512))
    tree[:, 256:] = cube.reshape(-1, 256)
    for k in range(255, 0, -1):
        tree[:, k] = tree[:, 2 * k] + tree[:, 2 * k + 1]
    one = np.tile(tree.reshape(CLASSES, CLASSES, 512).sum(0), (CLASSES, 1))
    none = np.broadcast_to(tree.sum(0), tree.shape)
    inner = np.arange(1, 256)

    def inputs(less0: int, less1: int) -> np.ndarray:
        return np.stack([np.log((np.maximum(t[:, 2 * inner + 1] - less1, 0) + PRIOR) / (np.maximum(t[:, 2 * inner] - less0, 0) + PRIOR)) for t in (none, one, tree)], axis=2)

    def gate(less: int) -> np.ndarray:
        return np.searchsorted([0.5, 3.5, 30.5], tree[:, inner] - less)

    w = np.tile([0.3, 0.3, 0.4], (4, 1))
    seen = [(tree[:, 2 * inner + b], np.full(tree[:, inner].shape, b), inputs(1 - b, b), gate(1)) for b in (0, 1)]
    for _ in range(6):
        a, g = np.tile(np.eye(3), (4, 1, 1)), np.zeros((4, 3))
        for n, y, x, which in seen:
            for k in range(4):
                on = (which == k) & (n > 0)
                v, p = x[on], 1 / (1 + np.exp(-np.clip(x[on] @ w[k], -20, 20)))
                g[k] += ((y[on] - p) * n[on]) @ v
                a[k] += (v * (p * (1 - p) * n[on])[:, None]).T @ v
        w = np.clip(w + np.linalg.solve(a, g[:, :, None])[:, :, 0], -1, 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(np.einsum("cni,cni->cn", inputs(0, 0), w[gate(0)]), -20, 20))), 1e-6, 1 - 1e-6)
    out, byte = np.zeros((CLASSES * CLASSES, 256)), np.arange(256)
    for k in range(8):
        node, bit = (256 + byte) >> (8 - k), ((byte >> (7 - k)) & 1).astype(bool)
        out += np.log10(np.where(bit, p[:, node - 1], 1 - p[:, node - 1]))
    return out.astype(np.float32)


def spelling(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the letters' cube for words data[s:e] with a blank at each end; each word's first."""
    n = e - s + 1
    at = np.cumsum(n) - n
    where = np.arange(int(n.sum())) - np.repeat(at, n)
    place = np.repeat(s, n) + where
    last = where == np.repeat(n - 1, n)
    byte = np.where(last, 32, data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else 32).astype(np.int64)
    kind = _CLASS[byte]
    one = np.where(where >= 1, np.concatenate([[26], kind[:-1]]) if len(kind) else kind, 26)
    two = np.where(where >= 2, np.concatenate([[26, 26], kind[:-2]])[: len(kind)] if len(kind) else kind, 26)
    return (two * CLASSES + one) * 256 + byte, at


def groups(first: np.ndarray, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces of texts, of ``PIECE`` tokens at most, and bounds of runs of pieces, of so many tokens at most. first: each text's first token, one more than texts.

    A longer text is read in pieces; what a piece's first words are predicted from doesn't reach back beyond it.
    """
    n = np.maximum(-(-np.diff(first) // PIECE), 1)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = np.append(np.repeat(first[:-1], n) + within * PIECE, first[-1])
    bounds = [0]
    while bounds[-1] < len(starts) - 1:
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(starts, starts[bounds[-1]] + most, "right")) - 1))
    return starts, np.array(bounds)


def pairs(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its place in its piece, topic and previous word. first: the pieces' starts."""
    n = len(symbol)
    within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    before = np.concatenate([[0], symbol[:-1]]) if n else symbol
    previous = np.where(within == 0, PREVS + 1, np.minimum(before, PREVS))
    rank, topic = np.minimum(symbol, TOPICS).astype(np.int16), np.full(n, TOPICS, np.int16)
    for k in range(1, BACK + 1):
        if k < n:
            np.minimum(topic[k:], rank[:-k], out=topic[k:], where=within[k:] >= k)
    return within, topic, previous


def contexts(topic: np.ndarray, previous: np.ndarray) -> list[np.ndarray]:
    return [C.splitmix(x.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(salt)) for x, salt in ((topic, 101), (previous, 202))]


def runs(skip: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of cells that skip what they have in common with the cell before, and have n bits more: level by level these bits' places, and the cells lo..hi that have each in common."""
    at, size = np.cumsum(n) - n - skip, skip + n
    skip, size = skip.astype(np.int16), size.astype(np.int16)
    for depth in range(int(size.max(initial=0))):
        head = np.flatnonzero(skip <= depth)
        longer = np.flatnonzero(size[head] > depth)
        lo = head[longer]
        yield at[lo] + depth, lo, np.append(head[1:], len(skip))[longer]


class Tokens:
    """Pieces of texts as tokens. Tokens that are predicted alike are one cell, with how many it has; cells are in the order of their words, or of what they are predicted from."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, predicted: np.ndarray, learned: np.ndarray, escape: int, codes: Codes | None = None, steps: bool = False):
        """ids of pieces in a row; each piece's first; predicted ids; whether each token's text was learned from. codes: given if cells that are predicted from the same (or from their own word) are to be together, in the order of their codes. steps: whether runs of these are then
        dealt to the steps of a lesson, in turn; else tokens know their cells.
        """
        n = len(ids)
        symbol = np.where(ids >= RARE, escape, ids).astype(np.int64)  # ids are of four bytes
        within, topic, previous = pairs(symbol, first)
        right, some = predicted == ids, predicted != NONE
        place = np.arange(n)
        wrong = np.maximum.accumulate(np.where(right, -1, place)) if n else place
        run = np.where(within == 0, 0, np.concatenate([[0], np.minimum(place[:-1] - wrong[:-1], within[:-1] + 1)]) if n else 0)
        missed = np.concatenate([[False], some[:-1] & ~right[:-1]]) & (within > 0) if n else some
        state = np.where(some, np.where(missed, 5, 1 + np.searchsorted([1, 4, 16], run, "right")), 0)
        prediction = np.where(some, np.where(predicted >= RARE, escape, predicted), 0).astype(np.int64)
        source = ((((topic.astype(np.int64) << 11) | previous) << 3 | state) << 18 | prediction) << 1 | learned
        if codes is None:
            self._keys = (symbol << 42) | source
            self._key, times = np.unique(self._keys, return_counts=True)
            self.symbol, self.times, self.shared = self._key >> 42, times.astype(np.float32), np.zeros(len(times), np.int64)
            key = self._key & ((1 << 42) - 1)
        else:
            source[right] |= OWN << 1  # each bit is predicted alike for all words that are rightly predicted
            key = (source << 18) | codes.rank[symbol]
            if steps:
                key, times = np.unique(key, return_counts=True)
            else:
                key, self.cell = np.unique(key, return_inverse=True)
            same = np.append(False, key[1:] >> 18 == key[:-1] >> 18)
            if steps:
                same &= np.arange(len(key)) % RUN > 0
                n = -(-len(key) // SLICE)
                step = np.cumsum(~same) % max(n, 1)
                order = np.argsort(step.astype(np.uint16), kind="stable")
                key, same, self.times = key[order], same[order], times[order]
                self.bounds = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=n))])
            self.symbol = codes.ranked[key & ((1 << 18) - 1)].astype(np.int64)
            key >>= 18
            self.shared = np.where(same, codes.common(np.append(self.symbol[:1], self.symbol[:-1]), self.symbol), 0)
        self.learned, self.state = key & 1, (key >> 19) & 7
        self.prediction = np.where(self.state > 0, (key >> 1) & OWN, -1)
        if codes is not None:
            self.prediction = np.where(self.prediction == OWN, self.symbol, self.prediction)
        self.context = contexts(key >> 33, (key >> 22) & 2047)
        #: Rare words, with the state and rightness of a match that has one, whether they are in the piece before, and how many distinct ones are before.
        self.rare = np.flatnonzero(ids >= RARE)
        self.guess = predicted[self.rare] >= RARE
        self.right, self.rare_state = self.guess & right[self.rare], state[self.rare]
        piece = np.searchsorted(first, self.rare, "right")
        _, head, again = np.unique(piece.astype(np.uint64) << _U(32) | ids[self.rare].astype(np.uint64), return_index=True, return_inverse=True)
        self.twice = head[again] != np.arange(len(self.rare))
        fresh = np.concatenate([[0], np.cumsum(~self.twice)])
        self.distinct = fresh[:-1] - fresh[np.searchsorted(piece, piece)]

    @functools.cached_property
    def cell(self) -> np.ndarray:
        """Each token's cell."""
        return np.searchsorted(self._key, self._keys)

    def __len__(self) -> int:
        return len(self.symbol)

    def slices(self) -> list[list[slice]]:
        """Cells to learn from at a time, each time some of all that words are predicted from; in blocks."""
        bounds = self.bounds.tolist()
        return [[slice(a, min(a + BLOCK, hi)) for a in range(lo, hi, BLOCK)] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def skipped(self, part: slice) -> np.ndarray:
        """How many bits each cell of a block has in common with the one before."""
        skip = self.shared[part].copy()
        skip[:1] = 0
        return skip


class Model:
    """Codes, two tables of counters (a byte for the zeros and one for the ones of each slot), weights by gate, and the refining table."""

    def __init__(self, codes: Codes, tables: np.ndarray):
        self.codes, self.tables = codes, tables
        self.escape = len(codes.size) - 2
        self.weights = np.zeros((GATES, INPUTS))
        self.weights[:, :3] = 0.3, 0.3, 0.4
        self.weights[:, 3] = np.repeat([0.0, 2.0, 3.0, 4.0, 5.0, 1.0], CONFS * CONFS)
        self.hit, self.seen = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        self.rare_hit, self.rare_seen = np.zeros(STATES + 1), np.zeros(STATES + 1)
        self.letters = np.full(CLASSES * CLASSES * 256, -np.log10(256), np.float32)

    def __getstate__(self) -> dict:
        """Sent compressed, as every executor keeps what it is sent in a file."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return {k: (v.dtype.str, v.shape, pack(v.tobytes())) if isinstance(v, np.ndarray) else v for k, v in {**self.__dict__, **{f"code_{k}": v for k, v in self.codes.__dict__.items()}}.items() if k != "codes"}

    def __setstate__(self, state: dict) -> None:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held = {k: np.frombuffer(unpack(v[2]), v[0]).reshape(v[1]) if isinstance(v, tuple) else v for k, v in state.items()}
        self.codes = Codes.__new__(Codes)
        self.codes.__dict__ = {k[5:]: v for k, v in held.items() if k.startswith("code_")}
        self.__dict__ |= {k: v for k, v in held.items() if not k.startswith("code_")}

    def ready(self) -> Model:
        """Look-up tables that aren't sent."""
        self.shift = _U(64 - (self.tables.shape[1].bit_length() - 1))
        c0, c1 = COUNT[np.arange(1 << 16) >> 8], COUNT[np.arange(1 << 16) & 255]
        self.odds = _log_odds(c0, c1).ravel()
        total = np.stack([c0 + c1, c0 + c1 - 1, c0 + c1 - 1])
        self.sure = np.searchsorted([0.5, 20.5], total.ravel()).astype(np.uint8)
        self.own = _log_odds(self.codes.zeros, self.codes.ones).ravel()
        self.mix = C.seeds(len(self.codes.zeros), 31)[self.codes.top] ^ (self.codes.place.astype(np.uint64) << self.shift)
        self.step = self.codes.node << 1 | self.codes.bit
        return self

    def path(self, symbol: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes and bits of symbols' codes after so many, and how many each has."""
        n = self.codes.size[symbol] - skip
        at = np.repeat(self.codes.start[symbol] + skip - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        step = self.step[at]
        return (step >> 1).astype(np.int64), (step & 1).astype(np.int8), n

    def counted(self, symbol: np.ndarray, context: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
        """Adds the bits of symbols after contexts to the counters of a table: of each slot its zeros and ones."""
        for a in range(0, len(symbol), SLICE):
            part = slice(a, a + SLICE)
            node, bit, n = self.path(symbol[part])
            at = ((np.repeat(context[part], n) ^ self.mix[node]) >> self.shift).view(np.int64)
            np.add.at(out, 2 * at + bit, np.repeat(times[part], n))

    def inputs(self, t: Tokens, part: slice, skip: np.ndarray | int = 0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Bits, the predictors' log-odds, gates, and how many bits each cell has; of each cell so many are skipped."""
        node, bit, n = self.path(t.symbol[part], skip)
        prediction, state = t.prediction[part], t.state[part]
        right = prediction == t.symbol[part]  # then all bits agree
        mode, mix = np.repeat(t.learned[part], n) * (1 + bit), self.mix[node]
        x, gate = [self.own[mode * len(self.codes.zeros) + node]], np.repeat(np.where(right, state, 0).astype(np.uint8), n)
        mode <<= 16
        for table, context in zip(self.tables, t.context, strict=True):
            at = np.repeat(context[part], n)
            at ^= mix
            at >>= self.shift
            cell = mode + table[at.view(np.int64)]
            x.append(self.odds[cell])
            gate *= CONFS
            gate += self.sure[cell]
        match = np.repeat(right.astype(np.float32), n)
        match *= 2 * bit - 1
        wrong = np.flatnonzero((prediction >= 0) & ~right)
        if len(wrong):
            end, own = np.cumsum(n), n[wrong]
            depth = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            on, p = np.repeat(end[wrong] - own, own) + depth, np.repeat(prediction[wrong], own)
            if np.ndim(skip):
                depth += np.repeat(skip[wrong], own)
            inside = depth < self.codes.size[p]
            at = self.codes.start[p] + np.where(inside, depth, 0)
            same = inside & (self.codes.node[at] == node[on])  # of one node at one depth, so all bits before agree
            match[on] = np.where(same, 2.0 * self.codes.bit[at] - 1, 0)
            gate[on[same]] += (np.repeat(state[wrong], own)[same] * CONFS * CONFS).astype(np.uint8)
        x.append(match)
        return bit, x, gate, n

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(self.weights.T, np.float32)
        out = w[INPUTS - 1][gate]
        for k, v in enumerate(x):
            add = w[k][gate]
            add *= v
            out += add
        return np.clip(out, -20, 20, out=out)

    def costs(self) -> np.ndarray:
        """log10 of a zero and of a one, by gate and bin of the mix: half the mix itself, half what came of such mixes."""
        z = (np.arange(BINS) + 0.5) * (2 * FAR / BINS) - FAR
        p = 1 / (1 + np.exp(-z))
        at = np.clip((z + REACH) * ((STEPS - 1) / (2 * REACH)), 0, STEPS - 1.001)
        lo, share = at.astype(np.int64), at - at.astype(np.int64)
        hit, seen = (v.reshape(GATES, STEPS)[:, lo] * (1 - share) + v.reshape(GATES, STEPS)[:, lo + 1] * share for v in (self.hit, self.seen))
        p = np.clip((p + (hit + TRUST * p) / (seen + TRUST)) / 2, 1e-6, 1 - 1e-6)
        return np.log10(np.stack([1 - p, p])).astype(np.float32).ravel()

    def log10(self, t: Tokens, costs: np.ndarray) -> np.ndarray:
        """Of each token. costs: log10 of the letters of each rare word, in order.

        What codes begin with in common, if their cells are predicted from the same, costs all of them alike, and is computed once.
        """
        out, table = np.zeros(len(t)), self.costs()
        for a in range(0, len(t), BLOCK):
            part = slice(a, a + BLOCK)
            skip = t.skipped(part)
            bit, x, gate, n = self.inputs(t, part, skip)
            gate = gate.astype(np.int64)
            at = gate * BINS + bit.astype(np.int64) * (GATES * BINS)
            at += np.clip((self.mixed(x, gate) + FAR) * (BINS / (2 * FAR)), 0, BINS - 1).astype(np.int64)
            cost, more = table[at], np.zeros(len(n) + 1)  # than the cell before
            for bits, lo, hi in runs(skip, n):
                each = cost[bits]
                more[lo] += each
                more[hi] -= each
            out[part] = np.cumsum(more[:-1])
        out = out[t.cell]
        p = (self.rare_hit + 0.5)[t.rare_state] / (self.rare_seen + 1)[t.rare_state]
        again = (self.rare_hit[-1] + 0.5) / (self.rare_seen[-1] + 1)
        letters = np.where(t.twice, np.log10(again) - np.log10(np.maximum(t.distinct, 1)), np.where(t.distinct > 0, np.log10(1 - again), 0) + costs)
        out[t.rare] += np.where(t.right, np.log10(p), np.where(t.guess, np.log10(1 - p), 0) + letters)
        return out


class Lesson:
    """Weights learned online over one bucket of texts, by steps of Newton's method whose curvature gathers."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = model.weights.copy()
        self.curve = np.tile(np.eye(INPUTS) * 4, (GATES, 1, 1))
        self.hit, self.seen = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        self.rare_hit, self.rare_seen = np.zeros(STATES + 1), np.zeros(STATES + 1)

    def learn(self, t: Tokens) -> None:
        """A step for each slice of cells. A bit that cells have in common is taken once, with all their tokens."""
        for cells in t.slices():
            grad = np.zeros((GATES, INPUTS))
            for part in cells:
                skip = t.skipped(part)
                bit, x, gate, n = self.model.inputs(t, part, skip)
                upto, times = np.concatenate([[0], np.cumsum(t.times[part])]), np.empty(len(bit), np.float32)
                for bits, lo, hi in runs(skip, n):
                    times[bits] = upto[hi] - upto[lo]
                grad += self._bent(gate, x, bit, times)
            step = np.linalg.solve(self.curve, grad[:, :, None])[:, :, 0]
            self.weights = np.clip(self.weights + np.clip(step, -1, 1), -2, 8)
        open_ = ~t.right & (t.distinct > 0)
        self.rare_seen += np.append(np.bincount(t.rare_state[t.guess], minlength=STATES), open_.sum())
        self.rare_hit += np.append(np.bincount(t.rare_state[t.right], minlength=STATES), (open_ & t.twice).sum())

    def _bent(self, gate: np.ndarray, x: list[np.ndarray], bit: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Adds what bits of so many tokens say to the curvature and to the refining table, and returns the gradient by gate. Bits of a gate are put together."""
        order = np.argsort(gate, kind="stable")
        size = np.bincount(gate, minlength=GATES)
        bounds = np.concatenate([[0], np.cumsum(size)]).tolist()
        parts = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        rows, both = np.ones((INPUTS, len(order)), np.float32), np.empty((INPUTS + 1, len(order)), np.float32)
        for k, v in enumerate(x):
            np.take(v, order, out=rows[k], mode="clip")
        bit, times, z, w = bit[order], times[order], np.empty(len(order), np.float32), self.weights.astype(np.float32)
        for g, run in parts:
            np.matmul(w[g], rows[:, run], out=z[run])
        np.clip(z, -20, 20, out=z)
        p = 1 / (1 + np.exp(-z))
        np.multiply(rows, p * (1 - p) * times, out=both[:-1])
        np.multiply(bit - p, times, out=both[-1])
        cell = np.clip(np.rint((z + REACH) * ((STEPS - 1) / (2 * REACH))), 0, STEPS - 1).astype(np.int64)
        cell += np.repeat(np.arange(GATES) * STEPS, size)
        self.hit += np.bincount(cell, bit * times, GATES * STEPS)
        self.seen += np.bincount(cell, times, GATES * STEPS)
        grad = np.zeros((GATES, INPUTS))
        for g, run in parts:
            add = (both[:, run] @ rows[:, run].T).astype(float)
            self.curve[g] += (add[:-1] + add[:-1].T) / 2
            grad[g] = add[-1]
        return grad

    def sums(self) -> np.ndarray:
        """What was learned, as whole numbers that buckets' are added by."""
        pull = np.einsum("gij,gj->gi", self.curve, self.weights)
        return np.rint(np.concatenate([v.ravel() for v in (self.curve, pull, self.hit, self.seen, self.rare_hit, self.rare_seen)]) * UNIT).astype(np.int64)

    @staticmethod
    def taught(model: Model, sums: np.ndarray) -> Model:
        """The model with weights averaged by their curvature, and the refining sums."""
        sizes = (GATES * INPUTS * INPUTS, GATES * INPUTS, GATES * STEPS, GATES * STEPS, STATES + 1, STATES + 1)
        curve, pull, model.hit, model.seen, model.rare_hit, model.rare_seen = np.split(sums / UNIT, np.cumsum(sizes)[:-1])
        model.weights = np.linalg.solve(curve.reshape(GATES, INPUTS, INPUTS), pull.reshape(GATES, INPUTS, 1))[:, :, 0]
        return model
