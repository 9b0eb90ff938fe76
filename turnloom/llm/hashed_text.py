"""Hashed word, prefix and character n-gram features of Arrow string batches, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes handled at once; the arrays of a piece take about forty times as much.
PIECE = 1 << 20

#: How far a feature that starts in a piece may look past its end.
OVERLAP = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.ones(256, bool)
_WORD[:48] = _WORD[58:65] = _WORD[91:97] = _WORD[123:128] = False

#: Bytes of words as white space separates them.
NOT_SPACE = ~_SPACE

#: The bucket of word pairs that repeat a word.
ECHO = 0

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        start = np.full(max(n, PIECE + OVERLAP + 1), base, np.uint64)
        start[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(start)
    return _powers[name][:n]


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


class Piece(NamedTuple):
    """Bytes start to end of the buffer; what starts there may be read on to ``readable``."""

    start: int
    end: int
    readable: int
    first_doc: int
    doc_starts: np.ndarray
    inner: bool


def pieces(offsets: np.ndarray, overlap: int = OVERLAP) -> Iterator[Piece]:
    """Whole documents together, and a long one in parts of its own."""
    n, k = len(offsets) - 1, 0
    while k < n:
        begin, stop = int(offsets[k]), int(offsets[k + 1])
        if stop - begin > PIECE:
            for a in range(begin, stop, PIECE):
                b = min(a + PIECE, stop)
                yield Piece(a, b, min(b + overlap, stop), k, np.array([a, b]), a > begin)
            k += 1
            continue
        j = max(int(np.searchsorted(offsets, begin + PIECE, "right")) - 1, k + 1)
        yield Piece(begin, int(offsets[j]), int(offsets[j]), k, offsets[k : j + 1], False)
        k = j


def _scatter(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of hashes, of one kind of feature."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * _MIX
        h ^= h >> np.uint64(32)
        return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def features(raw: np.ndarray, piece: Piece, bits: int, grams: tuple[int, ...] = (), prefixes: tuple[int, ...] = (), word_bytes: np.ndarray = _WORD, lower: bool = True, echoes: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, byte where it starts) of all features, one kind at a time.

    Kinds: n-grams of characters within a document, words, word prefixes of so many bytes and, with ``echoes``, the one bucket of
    all word pairs that repeat a word, once per byte of it. A word counts by its first ``OVERLAP`` bytes. In a longer one,
    as in scripts without spaces, every further character starts prefixes as a word does, so all of it is read.
    """
    a, starts = piece.start, piece.doc_starts
    data = raw[a : piece.readable]
    if lower:
        data = _LOWER[data]
    n, own = len(data), piece.end - a
    if not own:
        return
    docs = np.arange(piece.first_doc, piece.first_doc + len(starts) - 1)
    lengths = np.diff(starts)
    doc = np.repeat(docs, lengths)
    ends = np.repeat((starts[1:] - a) if piece.readable == piece.end else np.array([n]), lengths)
    wide = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * _power("p", _P, n), dtype=np.uint64)])
        if grams:
            first = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)  # where characters start
            mine = int(np.searchsorted(first, own))
            for g in sorted(grams):
                m = min(mine, len(first) - g)
                begin, stop = first[:m], first[g : g + m]
                ok = stop <= ends[begin]
                begin, stop = begin[ok], stop[ok]
                yield doc[begin], _scatter((total[stop] - total[begin]) * _power("inverse", _P_INV, n)[begin], g, bits), begin + a
        inside = word_bytes[data]
        edge = np.zeros(n, bool)
        edge[starts[:-1][starts[:-1] - a < n] - a] = True
        before = np.concatenate([[piece.inner and bool(word_bytes[raw[a - 1]])], inside[:-1]])
        if piece.inner:
            edge[0] = False
        at = np.flatnonzero((inside & (~before | edge))[:own])
        stop = np.concatenate([np.flatnonzero(~inside | edge), [n]])
        run_end = stop[np.searchsorted(stop, at, "right")]
        if prefixes:
            long = run_end - at > OVERLAP
            runs = list(zip(at[long].tolist(), run_end[long].tolist(), strict=True))
            if piece.inner and before[0] and inside[0]:  # a word from the part before
                earlier = word_bytes[raw[max(0, a - OVERLAP) : a]][::-1]
                reach = len(earlier) if earlier.all() else int(earlier.argmin())
                if reach + min(int(stop[0]), OVERLAP) > OVERLAP:
                    runs.insert(0, (-1, int(stop[0])))
            for first, last in runs:
                inner = np.arange(first + 1, min(last, own))
                inner = inner[(data[inner] & 0xC0) != 0x80]
                for p in prefixes:
                    whole = inner[inner + p <= last]
                    yield doc[whole], _scatter((total[whole + p] - total[whole]) * _power("inverse", _P_INV, n)[whole], 2000 + p, bits), whole + a
        if not len(at):
            return
        end = np.minimum(run_end, at + OVERLAP)
        back = _power("inverse", _P_INV, n)[at]
        word = _scatter((total[end] - total[at]) * back, 1001, bits)
        yield doc[at], word, at + a
        if echoes:
            again = 1 + np.flatnonzero((word[1:] == word[:-1]) & (doc[at[1:]] == doc[at[:-1]]))
            times = (end - at)[again]  # as much as the word's n-grams weigh
            yield np.repeat(doc[at[again]], times), np.full(times.sum(), ECHO), np.repeat(at[again] + a, times)
        for p in prefixes:
            ok = end - at > p
            yield doc[at[ok]], _scatter((total[at[ok] + p] - total[at[ok]]) * back[ok], 2000 + p, bits), at[ok] + a
