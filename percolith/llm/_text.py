"""Vectorised scans over UTF-8 text held in Arrow buffers.

A *block* is a slice of an Arrow string column: one byte buffer and the offsets of its documents.
Words are found and hashed for a whole block with a few numpy passes; no Python object is made per
word.  Hashes are polynomials modulo 2**64 read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text per block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


_PLAIN, _ALNUM = bytearray(b"\1" * 256), bytearray(256)
for _b in (9, 10, 11, 12, 13, 32):
    _PLAIN[_b] = 0
for _b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _ALNUM[_b] = 1

#: Translation of bytes that lowers A-Z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SAME = bytes(range(256))

#: Word classes, as (which bytes make words, how bytes count): ``plain`` runs of anything but ASCII white
#: space; ``folded`` the same with A-Z lowered; ``alnum`` runs of ASCII letters, digits and any byte from
#: 0x80 on, with A-Z lowered.
CLASSES = {"plain": (bytes(_PLAIN), _SAME), "folded": (bytes(_PLAIN), LOWER), "alnum": (bytes(_ALNUM), LOWER)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for blocks of usual size are kept."""
    key, have = int(base), _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 2), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * BLOCK_BYTES + 2:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``salt`` gives independent functions."""
    h = h ^ _U((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def as_letters(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8).astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of values[s:e] for each span, from prefix sums; independent of where the span stands."""
    n = len(values)
    base, inverse = (_BASE, _INVERSE) if not salt else _salted(salt)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(inverse, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F), salt)


def _salted(salt: int) -> tuple[np.uint64, np.uint64]:
    base = (int(_BASE) * (2 * salt + 1) ^ (salt << 17)) & 0xFFFFFFFFFFFFFFFF | 1
    return _U(base), _U(pow(base, -1, 1 << 64))


class Block:
    """Documents ``first .. first+n-1`` of a batch: ``buf`` bytes, ``off`` their n+1 offsets into it."""

    __slots__ = ("first", "buf", "off")

    def __init__(self, first: int, buf: np.ndarray, off: np.ndarray):
        self.first, self.buf, self.off = first, buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, positions, side="right") - 1

    def document(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


class Words:
    """Words of a block: byte ``starts`` and ``ends``, ``hash``, and ``first`` word of each document (n+1)."""

    __slots__ = ("starts", "ends", "hash", "first")

    def __init__(self, block: Block, kind: str, hashed: bool = True):
        word, letters = CLASSES[kind]
        raw, off = block.buf.tobytes(), block.off
        n = len(raw)
        inside = np.frombuffer(raw.translate(word), bool)
        begin, last = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            heads = off[:-1][off[:-1] < off[1:]]
            tails = off[1:][off[:-1] < off[1:]] - 1
            begin[heads] = inside[heads]
            last[tails] = inside[tails]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, off)
        self.hash = spans_hash(as_letters(raw.translate(letters)), self.starts, self.ends) if hashed else None

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``length`` words within one document."""
        count = np.maximum(np.diff(self.first) - length + 1, 0)
        at = ranges(self.first[:-1], count)
        return at, spans_hash(self.hash, at, at + length, salt)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. for counts[0] values, then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[np.cumsum(counts)[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if offsets else np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf, off


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a column in blocks of about ``size`` bytes, in order; every document is in one block."""
    buf, off = text_buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n, i + 65536)
        yield Block(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as disjoint spans that do not touch, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return starts[at], reach[np.r_[at[1:] - 1, len(starts) - 1]]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of values[i:i+width], for each i that has a full window, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = values.copy(), np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        right = best[step : step + m] < best[:m]
        at = np.where(right, at[step : step + m], at[:m])
        best = np.where(right, best[step : step + m], best[:m])
        have += step
    return at[:n]


def anchored_runs(values: np.ndarray, first: np.ndarray, length: int, gram: int, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split every document's windows of ``length`` items into runs that share an anchor.

    ``values[i]`` is the hash of the ``gram`` items from i; ``first`` holds the documents' first items
    (n+1).  A window's anchor is the leftmost of its grams of least value, where grams whose value has
    no bit of ``mask`` set go before all others.  It follows from the window's items alone, so equal
    windows have equal anchors at equal offsets.  Returns anchor, first and last window of each run;
    together the runs hold each window once.
    """
    width = length - gram + 1
    begin, last = first[:-1], first[1:] - length
    has = last >= begin
    begin, last = begin[has], last[has]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero((values & values.dtype.type(mask)) == 0)
    doc = np.searchsorted(begin, at, side="right") - 1
    keep = doc >= 0
    at, doc = at[keep], doc[keep]
    keep = at <= last[doc] + width - 1
    at, doc = at[keep], doc[keep]
    v, n = values[at], len(at)
    lo, hi = np.maximum(begin[doc], at - width + 1), np.minimum(at, last[doc])
    open_, k = np.arange(n), 1
    while len(open_):  # the nearest earlier value that is not larger
        open_ = open_[open_ >= k]
        left = open_ - k
        near = at[left] >= lo[open_]
        open_, left = open_[near], left[near]
        done = v[left] <= v[open_]
        lo[open_[done]] = at[left[done]] + 1
        open_, k = open_[~done], k + 1
    open_, k = np.arange(n), 1
    while len(open_):  # the nearest later value that is smaller
        open_ = open_[open_ + k < n]
        right = open_ + k
        near = (at[right] - width < hi[open_]) & (doc[right] == doc[open_])
        open_, right = open_[near], right[near]
        done = v[right] < v[open_]
        hi[open_[done]] = at[right[done]] - width
        open_, k = open_[~done], k + 1
    keep = lo <= hi
    anchors, los, his = [at[keep]], [lo[keep]], [hi[keep]]
    # windows without any such gram: between two of them, or between one and an end of its document
    edge = np.r_[at, begin - 1, last + width]
    order = np.lexsort((edge, np.r_[doc, np.arange(len(begin)), np.arange(len(begin))]))
    edge, of = edge[order], np.r_[doc, np.arange(len(begin)), np.arange(len(begin))][order]
    for j in np.flatnonzero((of[1:] == of[:-1]) & (edge[1:] - edge[:-1] > width)):
        a, b = edge[j] + 1, edge[j + 1] - width
        found = window_minimum(values[a : b + width], width) + a
        new = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        anchors.append(found[new])
        los.append(a + new)
        his.append(a + np.r_[new[1:], len(found)] - 1)
    return np.concatenate(anchors), np.concatenate(los), np.concatenate(his)


def byte_grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of the ``gram`` bytes from each position (a multiple of 8), by doubling."""
    g = buf.astype(np.uint32) + np.uint32(1)
    g *= np.uint32(0x9E3779B1)
    g ^= g >> np.uint32(15)
    base, have = 0x85EBCA6B, 1
    while have < 8:
        g = g[:-have] * np.uint32(base) + g[have:] if len(g) > have else g[:0]
        base, have = base * base & 0xFFFFFFFF, have * 2
    n = len(buf) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = g[:n].copy()
    for k in range(8, gram, 8):
        total *= np.uint32(base)
        total += g[k : k + n]
    total ^= total >> np.uint32(16)
    total *= np.uint32(0x7FEB352D)
    total ^= total >> np.uint32(15)
    return total
