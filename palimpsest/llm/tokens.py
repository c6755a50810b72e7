"""Pre-token encoding shared by token counts and binary output.

A pre-token is a run between ASCII blanks, cut where a Latin letter meets ASCII punctuation (not after an apostrophe). The
vocabulary's normaliser and splitter never look across either boundary, so a text's ids are its pre-tokens' ids in a row.
A worker keeps the ids of the pre-tokens it has met in a hash table of bounded size; the vocabulary's own words, which
byte-pair training picks by their frequency, are in it from the start. Lower-case Latin words that are new are encoded
many at a time by merging in arrays; anything else goes to the library. Both give the library's ids.

A null or empty text has no pre-tokens, so no ids but an end id that is asked for; rows are encoded each on its own, repeated or not. Of pre-tokens that are equally frequent any may be told as frequent: nothing but
speed depends on it.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from . import common as C

#: Pre-tokens that a worker's table holds before it starts afresh from the vocabulary's.
TABLE_WORDS = 1 << 20
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LETTER = np.array([97 <= b <= 122 or 65 <= b <= 90 for b in range(256)])
_MARK = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_OPEN = _MARK & (np.arange(256) != 0x27)


def _byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


class Merger:
    """Byte-pair merging of many words at once, for vocabularies whose words end in a suffix."""

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        pairs = [(a, b) for a, b in pairs if a in vocab and b in vocab and a + b in vocab]
        keys = self._mix(np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64))
        _, first = np.unique(keys, return_index=True)
        first.sort()
        self.ranks = C.HashTable(18)
        self.ranks.add(keys[first], first.astype(np.int32))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    @staticmethod
    def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return C.splitmix(((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) + np.uint64(1))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has. Words of the same length are merged together."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            n = int(lengths[order[at]])
            top = min(int(np.searchsorted(lengths[order], n, "right")), at + max(1, (1 << 20) // n))
            rows = order[at:top]
            at = top
            raw = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), n)
            sym = self.inner[raw]
            sym[:, -1] = self.final[raw[:, -1]]
            full = self._merge(sym)
            counts[rows] = (full >= 0).sum(axis=1)
            parts.append((rows, full))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for rows, full in parts:
            held = full >= 0
            where = (ends[rows] - counts[rows])[:, None] + np.cumsum(held, axis=1) - 1
            out[where[held]] = full[held]
        return out, counts

    def _merge(self, sym: np.ndarray) -> np.ndarray:
        """sym: a row of symbols for each word; returns it merged, with -1 where a symbol went into the one before it.

        Neighbours are kept as positions, so that a merge touches a few entries of a row and only the search for the lowest rank reads it whole.
        """
        m, n = sym.shape
        if n == 1:
            return sym
        none = np.int32((1 << 31) - 1)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            r = self.ranks.get(self._mix(a, b))
            return np.where(r >= 0, r, none)

        flat = sym.reshape(-1)
        after = np.tile(np.arange(1, n + 1), m)
        before = np.tile(np.arange(-1, n - 1), m)
        ranks = np.full((m, n), none, np.int32)
        ranks[:, :-1] = rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(m, n - 1)
        base = np.arange(m) * n
        while len(base):
            at = ranks.argmin(axis=1)
            row = np.arange(len(base))
            best = ranks[row, at]
            live = best != none
            if 2 * np.count_nonzero(live) < len(base):
                ranks, base = ranks[live], base[live]
                at, best, row = at[live], best[live], np.arange(len(base))
            else:
                row, at, best = row[live], at[live], best[live]
            if not len(row):
                break
            top = base[row]
            p = top + at
            j = after[p]
            k = after[top + j]
            flat[p], flat[top + j] = self.merged[best], -1
            ranks[row, j] = none
            after[p] = k
            more = k < n
            ranks[row[~more], at[~more]] = none
            pm, km = p[more], top[more] + k[more]
            before[km] = at[more]
            ranks[row[more], at[more]] = rank(flat[pm], flat[km])
            i = before[p]
            left = i >= 0
            ranks[row[left], i[left]] = rank(flat[top[left] + i[left]], flat[p[left]])
        return sym


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z and capital Latin-1 letters in lower case, but for those before what may be a combining mark; where to cut."""
    if len(data) < 2:
        return C.LOWER[data], np.zeros(0, np.int64)
    two = np.zeros(len(data), bool)
    two[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    safe = np.ones(len(data), bool)
    safe[:-1] = data[1:] < 0xCC
    out = np.where(safe, C.LOWER[data], data)
    out[two & safe & (data <= 0x9E)] += 0x20
    letter = _LETTER[data] | two
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & _MARK[data[1:]]) | (_OPEN[data[:-1]] & _LETTER[data[1:]])
    return out, np.flatnonzero(cut)


class Splitter:
    """Pre-tokens of texts, as the vocabulary's normaliser and splitter would have them."""

    def __init__(self, path: str):
        with open(path) as f:
            self.spec = spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        #: Lower-casing in advance changes nothing when the vocabulary's normaliser does it.
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer") or {})

    def pre_tokens(self, col: pa.Array):
        """For each chunk of texts: rows lo, hi, the bytes, its pre-tokens' starts, ends and hashes, and each text's first."""
        for lo, hi, data, offs in C.chunks(col):
            cuts = None
            if self.lower and not any(x in data.tobytes() for x in self.special):
                data, cuts = _lowered(data)
            s, e, first = C.word_bounds(data, offs, C.BLANK_WORD, cuts)
            yield lo, hi, data, s, e, C.word_hashes(data, s, e), first


class Encoder(Splitter):
    """Ids of whole texts, without begin, end or added special tokens; special tokens' strings are what the library makes of them."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS, ready: tuple | None = None):
        from tokenizers import Tokenizer

        super().__init__(path)
        spec = self.spec
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        plain = spec["model"].get("end_of_word_suffix") and "ByteLevel" in json.dumps(spec.get("pre_tokenizer") or {}) and not spec["model"].get("ignore_merges")
        self.merger = Merger(spec) if plain and self.lower else None
        self.most = max([t["id"] for t in spec.get("added_tokens", [])] + list(spec["model"]["vocab"].values()))
        self.table_words, self.ready = table_words, ready
        self._fresh()

    def _fresh(self) -> None:
        self.table = C.HashTable(20)
        self.arena, self.start, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = self.words = 0
        if self.ready is not None:
            hashes, ids, counts = self.ready
            self._put(hashes, ids, counts)

    def _put(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = self.words + len(h), self.used + len(ids)
        for name, need in (("arena", m), ("start", n), ("count", n)):
            a = getattr(self, name)
            if need > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)]))
        self.arena[self.used : m] = ids
        self.count[self.words : n] = counts
        self.start[self.words : n] = self.used + np.cumsum(counts) - counts
        self.table.add(h, np.arange(self.words, n, dtype=np.int32))
        self.words, self.used = n, m

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self.merger is not None and len(w) <= 64 and ((w.isalpha() and w.islower()) or _PLAIN.fullmatch(w) is not None) for w in words]
        fast = [w for w, p in zip(words, plain, strict=True) if p]
        slow = [w for w, p in zip(words, plain, strict=True) if not p]
        got = [e.ids for e in self.library.encode_batch([w.decode() for w in slow], add_special_tokens=False)] if slow else []
        if not fast:
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        ids, n = self.merger.encode(fast)
        if not slow:
            return ids.astype(np.uint32), n
        mask = np.array(plain)
        counts = np.zeros(len(words), np.int64)
        counts[mask], counts[~mask] = n, [len(x) for x in got]
        out = np.zeros(int(counts.sum()), np.uint32)
        of = np.repeat(mask, counts)
        out[of], out[~of] = ids, [i for x in got for i in x]
        return out, counts

    def _rows(self, col: pa.Array):
        """For each chunk of texts: rows lo, hi, the table rows of its pre-tokens, and each text's first."""
        for lo, hi, data, s, e, h, first in self.pre_tokens(col):
            row = self.table.get(h)
            new = np.flatnonzero(row < 0)
            if len(new):
                if self.words + len(new) > self.table_words + (len(self.ready[0]) if self.ready else 0):
                    self._fresh()
                    row = self.table.get(h)
                    new = np.flatnonzero(row < 0)
                hs, at = np.unique(h[new], return_index=True)
                raw, a, b = data.tobytes(), s[new[at]].tolist(), e[new[at]].tolist()
                self._put(hs, *self.encode_words([raw[x:y] for x, y in zip(a, b, strict=True)]))
                row[new] = self.table.get(h[new])
            yield lo, hi, row, first

    def counts(self, col: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for _, _, row, first in self._rows(col):
            upto = np.concatenate([[0], np.cumsum(self.count[row], dtype=np.int64)])
            out.append(upto[first[1:]] - upto[first[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def ids(self, col: pa.Array, end: int | None = None):
        """For each chunk: all ids in a row, an end id after each text, and how many each text has."""
        for lo, hi, row, first in self._rows(col):
            n = self.count[row].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(self.start[row] - upto[:-1], n) + np.arange(upto[-1])
            ids, own = self.arena[at], upto[first[1:]] - upto[first[:-1]]
            if end is not None:
                ids, own = np.insert(ids, upto[first[1:]], end), own + 1
            yield ids, own


def frequent(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, ids and counts of the words that the vocabulary holds whole: as many as it has entries at most."""
    with open(path) as f:
        spec = json.load(f)
    suffix = spec["model"].get("end_of_word_suffix") or ""
    back = {c: b for b, c in enumerate(_byte_letters())}
    words = set()
    for token in spec["model"]["vocab"]:
        if suffix and token.endswith(suffix) and token != suffix and all(c in back for c in token[: -len(suffix)]):
            raw = bytes(back[c] for c in token[: -len(suffix)])
            if _PLAIN.fullmatch(raw) or raw in (b".", b","):
                words.add(raw)
    return encoded(path, sorted(words))


def encoded(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, all ids in a row, and how many ids each of distinct pre-tokens has."""
    ids, counts = Encoder(path).encode_words(words)
    return C.hash_words(words), ids, counts


def common_in(batches, path: str, most: int, held: int = 1 << 18):
    """texts -> word and n: a task's most frequent pre-tokens. Where more than held are counted, the rarer half is forgotten, so that memory is bounded; nothing but speed depends on them."""
    enc = Splitter(path)
    count = np.zeros(0, np.int64)
    hashes, words = np.zeros(0, np.uint64), []
    for batch in batches:
        for _, _, data, s, e, h, _ in enc.pre_tokens(batch.column(0)):
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            new = ~np.isin(u, hashes, assume_unique=True)
            words += [raw[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            hashes, count = np.concatenate([hashes, u[new]]), np.concatenate([count, np.zeros(int(new.sum()), np.int64)])
            order = np.argsort(hashes)
            count[order[np.searchsorted(hashes[order], u)]] += n
            if len(hashes) > held:
                keep = np.sort(np.argsort(-count, kind="stable")[: held // 2])
                hashes, count, words = hashes[keep], count[keep], [words[i] for i in keep.tolist()]
    top = np.argsort(-count, kind="stable")[:most].tolist()
    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in top], pa.binary()), pa.array(count[top], pa.int64())], names=["word", "n"])


_encoders: dict[str, tuple[str, Encoder]] = {}


def encoder(path: str, name: str = "", ready: tuple | None = None) -> Encoder:
    """One for each vocabulary in a worker, kept between tasks of the same name. ready: hashes, ids and counts of ids of pre-tokens that are in its table from the start."""
    if _encoders.get(path, ("?",))[0] != name:
        _encoders[path] = (name, Encoder(path, ready=ready))
    return _encoders[path][1]
