"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a longest run of bytes other than space, tab, LF, VT, FF and CR. Words are known by 64-bit hashes: each 8 bytes
are mixed with their place by a bijection, and the sum over a word is mixed with its length. Entries of vocabularies, which are short,
have polynomials over the bytes, taken as differences of one running sum (long texts could be made to collide there).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
PLAIN = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
BASE = 0x9E3779B97F4A7C15
WINDOW = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64; a bijection of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64, kept by the process: a global here would go with each function."""
    kept = vars(sys).setdefault("_agora_powers", {})
    if len(kept.get("up", ())) < n + 1:
        size = max(n + 1, 2 * len(kept.get("up", ())), WINDOW // 4)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            kept[name] = np.cumprod(a, dtype=np.uint64)
    return kept["up"], kept["down"]


def sums(buf: np.ndarray) -> np.ndarray:
    """Running sums by which span_hash() gives the hash of any short span of buf."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(PLAIN[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((run[ends] - run[starts]) * powers(len(run))[1][starts] + (ends - starts).astype(np.uint64))


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty. offsets[0] need not be 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = arr.fill_null("") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def edges(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf; offs are places that no word crosses."""
    word = ~SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offs[offs < len(buf)]
    first[at] |= word[at]
    at = offs[offs > 0] - 1
    last[at] |= word[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def windows(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about WINDOW bytes that cut no word; together they cover offs[0] to offs[-1]."""
    at, end = int(offs[0]), int(offs[-1])
    while at < end:
        to = min(at + WINDOW, end)
        if to < end:
            i = np.searchsorted(offs, to, "right") - 1
            if offs[i] > at:
                to = int(offs[i])
            else:
                stop = int(offs[i + 1])
                while to < stop:
                    gap = np.flatnonzero(SPACE[buf[to : min(to + WINDOW, stop)]])
                    to = to + int(gap[0]) if len(gap) else min(to + WINDOW, stop)
                    if len(gap):
                        break
        yield at, to
        at = to


def word_hashes(buf: np.ndarray, offs: np.ndarray, fold: np.ndarray | None = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one more at the end)."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in windows(buf, offs):
        part = buf[a:b]
        lo, hi = np.searchsorted(offs, [a, b])
        s, e = edges(part, offs[lo : hi + 1][offs[lo : hi + 1] <= b] - a)
        hashes.append(spans_hash(part, s, e, fold))
        starts.append(s + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, by the place of its first word (runs may cross texts: the caller masks them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = out * U(0xD1342543DE82EF95) + hashes[k : k + m]
    return mix(out)


def shingle_sets(arr: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingles; with fewer words the whole sequence as one; without words none."""
    buf, offs = column(arr)
    h, at = word_hashes(buf, offs)
    g = grams(h, n)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield grams(h[a:b], int(b - a)) + U(b - a)
        else:
            yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, name: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about size bytes of text, one row at least."""
    arr = batch.column(name)
    _, offs = column(arr)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: The first bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ascending spans that do not overlap, in windows of bounded memory; spans may be longer than a window. fold is a
    table of bytes by which each is replaced first."""
    out = (ends - starts).astype(np.uint64) * U(0xD1342543DE82EF95)
    first = np.concatenate([[0], np.cumsum((ends - starts + 7) // 8)])  # the blocks of 8 bytes of all spans, in a row
    for a in range(0, int(first[-1]), WINDOW // 8):
        b = min(a + WINDOW // 8, int(first[-1]))
        lo, hi = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b))
        cut = np.clip(first[lo : hi + 1], a, b)
        span = np.repeat(np.arange(lo, hi), np.diff(cut))
        place = np.arange(a, b) - first[span]
        at = starts[span] + 8 * place
        part = buf[at[0] : at[-1] + 8]
        part = np.concatenate([part if fold is None else fold[part], np.zeros(at[-1] + 8 - at[0] - len(part), np.uint8)])
        eight = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))[at - at[0]] & _FIRST[np.minimum(ends[span] - at, 8)]
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(mix(eight + (place + 1).astype(np.uint64) * U(BASE)), out=run[1:])
        out[lo:hi] += run[cut[1:] - a] - run[cut[:-1] - a]
    return mix(out)
