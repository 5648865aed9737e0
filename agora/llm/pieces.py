"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into chunks of CHUNK characters, wherever that falls. A boundary state is the piece that crosses the cut, by its
start and end, or ends there. For each chunk a transfer matrix holds the best score from each state at its left to each at
its right, in the semiring of maximum and plus; matrices are combined associatively into the state at every cut, and each
chunk then walks back through its own pieces alone. A text of one chunk is the case of one state on either side. The chunks of
texts of SPREAD bytes or more are dealt out over the cluster; those of others stay in one task, by the same scan.

For unigram models scores add up. For BPE models a segmentation is the encoder's own if and only if each piece and each pair of
neighbours encodes to itself, so that pairs score 0 or minus infinity and the only finite path is the encoding. So the scan
gives the very ids that the model's own library gives for the whole text; the library itself takes no part.

Pieces never run from another character into a word mark, so that a text falls into segments that start at marks ("hard"
bounds; checked against the vocabulary at load). Segments inside a chunk are scalars of the scan. Their lattices are solved many
at a time with numpy, place by place, each distinct segment once as long as it is remembered, by a hash of 64 bits.
Every prefix of a segment has one best segmentation, so that at each place one state suffices.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import tokens
from agora.llm.shared import bounded, cut, fresh, tidied

CHUNK, SPREAD = 1 << 14, 1 << 20
#: Distinct segments, and pairs of pieces, that a task remembers.
MEMORY = 1 << 19
#: Characters up to which segments are solved together, and how many at once.
SHORT, BLOCK = 32, 1 << 15
#: Bytes of text that a task encodes at once.
SLICE = 1 << 21
MARK = "▁"
NONE = float("-inf")
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class Lookup:
    """Whole numbers by 64-bit keys other than 0, many at a time, with open addressing."""

    def __init__(self, size: int = 1 << 12):
        self.n, self.bits = 0, max(4, (2 * size - 1).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (tokens.mix(keys) >> tokens.U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        out, at, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(at):
            found = self.keys[slot]
            hit = found == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found != 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys != 0
            old, was = self.keys[held], self.values[held]
            self.__init__(max(self.n + len(keys), 3 * self.n // 2))
            self._place(old, was)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.n += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            on = np.ones(len(keys), bool)
            on[first] = False
            keys, values, slot = keys[on], values[on], (slot[on] + 1) & ((1 << self.bits) - 1)


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool that begin at starts, one after another, and where each of them begins (one more at the end)."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return pool[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


class Model:
    """A SentencePiece vocabulary with byte fallback or an unknown piece, and identity normalisation."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(blob)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("the model normalises texts; only models that keep them as they are can be used")
        self.bpe = m.trainer_spec.model_type == 2
        self.prefix = m.normalizer_spec.add_dummy_prefix
        kind = pb.ModelProto.SentencePiece
        self.text = [p.piece for p in m.pieces]
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN)
        self.byte = {int(BYTE.match(p.piece)[1], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        plain = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.ids = {k: i for k, (i, _) in plain.items()}
        self.score = {k: s for k, (_, s) in plain.items()}
        self.longest = max(map(len, plain))
        self.rare = min(self.score.values(), default=0.0) - 10.0
        if any(b == MARK and a != MARK for p in plain for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece runs into a word mark: segments would not be independent")
        long = [p for p in plain if len(p) > 1]
        joined = set("".join(long))
        #: Characters that only stand alone: every place beside one is a hard bound.
        self.alone = frozenset(chr(c) for c in range(128)) - joined
        single = re.escape("".join(sorted(self.alone)))
        self.segment = re.compile(f"[{single}]|{MARK}+[^{MARK}{single}]*|[^{MARK}{single}]+" if single else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.special = {i for i, p in enumerate(m.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.bytes_of = [bytes([int(BYTE.match(p.piece)[1], 16)]) if p.type == kind.BYTE else (b"" if i in self.special else p.piece.replace(MARK, " ").encode()) for i, p in enumerate(m.pieces)]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._byte_sizes = np.array([len(x) for x in self.bytes_of])
        self._byte_pool, self._byte_starts = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.concatenate([[0], np.cumsum(self._byte_sizes)[:-1]])
        self._alone = np.zeros(256, bool)
        self._alone[[ord(c) for c in self.alone if c != " "]] = True  # in bytes, a blank is a mark
        self._tables(plain)
        self._forget()

    def _tables(self, plain: dict[str, tuple[int, float]]) -> None:
        """Pieces by the hash of their bytes; for BPE the merges by their parts, each piece's characters, which pieces hold."""
        v = self.nothing = len(self.text)  # stands for a character that is no piece
        names = [p.replace(MARK, " ").encode() for p in plain]
        ends = np.cumsum([len(x) for x in names])
        ids = np.array([i for i, _ in plain.values()], np.int32)
        self._pieces = Lookup(len(plain))
        self._pieces.put(tokens.span_hash(tokens.sums(np.frombuffer(b"".join(names), np.uint8)), np.concatenate([[0], ends[:-1]]), ends), ids)
        self._scores = np.full(v + 1, self.rare)
        self._scores[ids] = [s for _, s in plain.values()]
        self._holds = np.ones(v + 1, bool)
        if self.bpe:
            merges = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, (i, _) in plain.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
            left, right, made = np.array(merges or [(0, 0, 0)]).T
            self._merges = Lookup(len(merges))
            self._merges.put((left * (v + 1) + right + 1).astype(np.uint64), made.astype(np.int32))
            self._chars = np.full((v + 1, self.longest), -1, np.int32)
            self._chars[v, 0] = v
            for p, (i, _) in plain.items():
                self._chars[i, : len(p)] = [self.ids.get(c, v) for c in p]
            self._holds[ids] = [len(p) == 1 for p in plain]
            self._holds[ids] |= self._merged(self._chars[ids])[:, 0] == ids

    def _forget(self) -> None:
        self._known, self._fit = Lookup(), Lookup()
        self._pool, self._starts, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def escape(self, text: str) -> str:
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def merge(self, text: str) -> list[str]:
        """BPE: of all neighbours whose union is a piece, those of the best score are merged, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], NONE)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are side by side under BPE; either may be empty."""
        key = (left, right)
        if (ok := self._pairs.get(key)) is None:
            ok = self._pairs[key] = self.merge(left + right) == [p for p in key if p]
            if len(self._pairs) > MEMORY:
                self._pairs.clear()
        return ok

    def edge(self, piece: str) -> float:
        """The score of a piece; minus infinity if it is none."""
        if self.bpe:
            return 0.0 if (len(piece) == 1 or piece in self.ids) and self._fits(piece, "") else NONE
        return self.score.get(piece, self.rare if len(piece) == 1 else NONE)

    def pair(self, left: str, right: str) -> float:
        return 0.0 if not self.bpe or self._fits(left, right) else NONE

    def starts(self, text: str, p: int) -> list[int]:
        """Ends of the pieces that start at p."""
        return [p + n for n in range(1, min(self.longest, len(text) - p) + 1) if (n == 1 or text[p : p + n] in self.ids) and self.edge(text[p : p + n]) > NONE]

    def lattice(self, text: str, into: list[tuple[int, int]], stop: int) -> tuple[dict, dict]:
        """Forward scores over the pieces of text that start before stop, from each state of into.

        A state (s, e) is the piece text[s:e], where s < e; (p, p) is a hard bound. Returns the score vectors by piece, one number
        for each state of into, and for each the best piece before it by state."""
        best = {state: np.where(np.arange(len(into)) == k, 0.0, NONE) for k, state in enumerate(into)}
        back: dict[tuple[int, int], list] = {state: [None] * len(into) for state in into}
        ending: dict[int, list[tuple[int, int]]] = {}
        for state in into:
            ending.setdefault(state[1], []).append(state)
        for p in range(min(e for _, e in into), stop):
            if p not in ending:
                continue
            for e in self.starts(text, p):
                piece = text[p:e]
                score, gain = np.full(len(into), NONE), self.edge(piece)
                origin: list = [None] * len(into)
                for s in ending[p]:
                    way = best[s] + (gain + (self.pair(text[s[0] : p], piece) if s[0] < p else 0.0))
                    for k in np.flatnonzero(way > score):
                        score[k], origin[k] = way[k], s
                if (score > NONE).any():
                    best[p, e], back[p, e] = score, origin
                    ending.setdefault(e, []).append((p, e))
        return best, back

    def path(self, text: str, start: tuple[int, int], end: tuple[int, int] | None = None) -> list[str]:
        """The best pieces from state start, itself left out, to state end, itself included; else to the end of text."""
        best, back = self.lattice(text, [start], end[0] + (end[0] < end[1]) if end else len(text))
        if end is None:
            end = max((s for s in best if s[1] == len(text)), key=lambda s: best[s][0])
        out = []
        while end is not None and end != start:
            out.append(text[end[0] : end[1]])
            end = back[end][0]
        return out[::-1]

    def _merged(self, rows: np.ndarray) -> np.ndarray:
        """merge() for many rows of pieces at once; -1 fills rows up."""
        rows, on, width = rows.copy(), np.arange(len(rows)), rows.shape[1]
        at = np.arange(width)
        while len(on) and width > 1:
            now = rows[on]
            left, right = now[:, :-1].astype(np.int64), now[:, 1:]
            made = np.where(right >= 0, self._merges.get((left * (self.nothing + 1) + right + 1).astype(np.uint64).ravel()).reshape(right.shape), -1)
            score = np.where(made >= 0, self._scores[made], NONE)
            best = score.argmax(1)
            some = score[np.arange(len(on)), best] > NONE
            on, now, best, made = on[some], now[some], best[some], made[some]
            now[np.arange(len(on)), best] = made[np.arange(len(on)), best]
            now = np.hstack([now, np.full((len(on), 1), -1, np.int32)])
            rows[on] = np.take_along_axis(now, at + (at > best[:, None]), 1)
        return rows

    def _pair_holds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """pair() for many pairs of pieces at once: whether they stay as they are side by side."""
        key = (left.astype(np.int64) * (self.nothing + 1) + right + 1).astype(np.uint64)
        found = self._fit.get(key)
        if (new := np.flatnonzero(found < 0)).size:
            fresh, back = np.unique(key[new], return_inverse=True)
            one = ((fresh - tokens.U(1)) // tokens.U(self.nothing + 1)).astype(np.int64)
            two = ((fresh - tokens.U(1)) % tokens.U(self.nothing + 1)).astype(np.int64)
            sizes = (self._chars[one] >= 0).sum(1), (self._chars[two] >= 0).sum(1)
            order, ok = np.argsort(sizes[0] + sizes[1], kind="stable"), np.zeros(len(fresh), np.int32)
            for k in range(0, len(order), 4096):
                part = order[k : k + 4096]
                a, b = sizes[0][part, None], sizes[1][part, None]
                at = np.arange(max(2, int((a + b).max())))[None, :]
                rows = np.where(at < a, self._chars[one[part, None], np.minimum(at, self.longest - 1)], np.where(at < a + b, self._chars[two[part, None], np.clip(at - a, 0, self.longest - 1)], -1))
                rows = self._merged(rows.astype(np.int32))
                ok[part] = (rows[:, 0] == one[part]) & (rows[:, 1] == two[part]) & ((rows[:, 2] < 0) if rows.shape[1] > 2 else True)
            if self._fit.n + len(fresh) > MEMORY:
                self._fit = Lookup()
            self._fit.put(fresh, ok)
            found[new] = ok[back]
        return found > 0

    def _lattices(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best pieces of many segments of buf, as ids one after another, and their number by segment.

        At each place the maximum is taken over the pieces that end there, of the score at their start and their own; under BPE
        they must fit the piece that ends at their start."""
        data, at = gathered(buf, starts, sizes)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(chars, at)
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        first, n, run = first[:-1][order], n[order], tokens.sums(data)
        width = int(n[0]) + 1 if len(n) else 1
        best, last, step = np.full((len(n), width), NONE), np.zeros((len(n), width), np.int32), np.zeros((len(n), width), np.int32)
        best[:, 0] = 0
        for e in range(1, width):
            rows = np.arange(int(np.searchsorted(-n, -e, "right")))
            end = chars[first[rows] + e]
            for k in range(min(e, self.longest), 0, -1):
                piece = self._pieces.get(tokens.span_hash(run, chars[first[rows] + e - k], end))
                if k == 1:
                    piece[piece < 0] = self.nothing
                some = np.flatnonzero((piece >= 0) & self._holds[piece])
                if self.bpe and e > k and some.size:
                    some = some[self._pair_holds(last[rows[some], e - k], piece[some])]
                way = best[rows[some], e - k] + (0.0 if self.bpe else self._scores[piece[some]])
                better = way > best[rows[some], e]
                some, way = some[better], way[better]
                best[rows[some], e], last[rows[some], e], step[rows[some], e] = way, piece[some], k
                if self.bpe and some.size:  # the only finite path
                    rest = np.ones(len(rows), bool)
                    rest[some] = False
                    rows, end = rows[rest], end[rest]
        found, pos = [], n.copy()
        while (on := np.flatnonzero(pos)).size:
            found.append((on, pos[on], last[on, pos[on]]))
            pos[on] -= step[on, pos[on]]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(n), np.int64)
        row, pos, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        sort = np.lexsort((pos, order[row]))
        row, pos, piece = row[sort], pos[sort], piece[sort]
        # Characters that are no piece: their bytes, or the unknown piece.
        lone = piece == self.nothing
        piece[lone] = self.unknown
        count = np.ones(len(piece), np.int64)
        if self.byte and lone.any():
            a = chars[first[row] + pos - 1]
            count[lone] = (chars[first[row] + pos] - a)[lone]
            where = np.concatenate([[0], np.cumsum(count)])
            ids = np.repeat(piece, count)
            spot = np.repeat(np.where(lone, a - where[:-1], 0), count) + np.arange(where[-1])
            loose = np.repeat(lone, count)
            ids[loose] = self._byte_ids()[data[spot[loose]]]
        else:
            ids = piece
        return ids, np.bincount(order[row], count, len(n)).astype(np.int64)

    def _byte_ids(self) -> np.ndarray:
        return np.array([self.byte.get(b, self.unknown) for b in range(256)], np.int32)

    def segmented(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments of buf between bounds, one after another, and where each of them begins (one more at the end)."""
        starts, sizes = bounds[:-1], np.diff(bounds)
        key = tokens.spans_hash(buf, starts, bounds[1:])
        key[key == 0] = tokens.U(1)
        found = self._known.get(key)
        if (new := np.flatnonzero(found < 0)).size:
            if self._known.n + new.size > MEMORY:
                self._forget()
                new = np.arange(len(key))
            fresh, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            ids, count = self._solved(buf, starts[new[at]], sizes[new[at]])
            n = len(self._starts)
            self._starts = np.concatenate([self._starts, len(self._pool) + np.cumsum(count) - count])
            self._sizes = np.concatenate([self._sizes, count])
            self._pool = np.concatenate([self._pool, ids])
            self._known.put(fresh, np.arange(n, n + len(fresh), dtype=np.int32))
            found[new] = n + back
        return gathered(self._pool, self._starts[found], self._sizes[found])

    def _solved(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments: short ones many at a time, long ones each by itself."""
        out, count = [], np.zeros(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), BLOCK):
            part = order[k : k + BLOCK]
            short = part[sizes[part] <= SHORT]
            ids, count[short] = self._lattices(buf, starts[short], sizes[short])
            out.append(ids)
            for i in part[len(short) :]:
                ids = np.array(self.numbers(self.straight(bytes(buf[starts[i] : starts[i] + sizes[i]]).decode().replace(" ", MARK))), np.int32)
                count[i] = len(ids)
                out.append(ids)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        return gathered(np.concatenate([np.zeros(0, np.int32), *out]), at, count)[0], count

    def straight(self, text: str) -> list[str]:
        """The best pieces of one segment."""
        n = len(text)
        best, back, last = [0.0] + [NONE] * n, [0] * (n + 1), [""] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                piece = text[s:e]
                if (e - s == 1 or piece in self.ids) and (gain := self.edge(piece)) > NONE:
                    way = best[s] + gain + (self.pair(last[s], piece) if s else 0.0)
                    if way > best[e]:
                        best[e], back[e], last[e] = way, s, piece
        out, e = [], n
        while e:
            out.append(last[e])
            e = back[e]
        return out[::-1]

    def solve(self, segments: list[str]) -> list[int]:
        """Ids of segments between hard bounds."""
        data = [s.replace(MARK, " ").encode() for s in segments]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        return self.segmented(np.frombuffer(b"".join(data), np.uint8), bounds)[0].tolist()

    def bounds(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The hard bounds of texts that lie one after another in buf, offs[0] being 0."""
        alone, blank = self._alone[buf], buf == 32
        start = alone | blank
        start[1:] |= alone[:-1]
        start[1:] &= ~(blank[1:] & blank[:-1])
        start[offs[:-1][offs[:-1] < len(buf)]] = True
        return np.append(np.flatnonzero(start), len(buf))

    def plain(self, text: str) -> np.ndarray:
        """Ids of an escaped text that begins and ends at hard bounds."""
        buf = np.frombuffer(text.replace(MARK, " ").encode(), np.uint8)
        return self.segmented(buf, self.bounds(buf, np.array([0, len(buf)])))[0] if len(buf) else np.zeros(0, np.int32)

    def encoded(self, arr: pa.Array, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts of a column one after another, where each text's begin (one more at the end), and its chunks."""
        arr = arr.fill_null("") if arr.null_count else arr
        size = pc.utf8_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
        size += self.prefix & (size > 0)
        long = np.flatnonzero(size > chunk)
        marked = pc.replace_substring(arr, MARK, " ")
        if self.prefix:
            marked = pc.if_else(pa.array(size > 0), pc.binary_join_element_wise(pa.scalar(" ", arr.type), marked, pa.scalar("", arr.type)), marked)
        if not len(long):
            ids, at = self._plainly(marked)
            return ids, at, (size > 0).astype(np.int64)
        # Texts of several chunks: what the scan leaves between the hard bounds of each chunk is solved with all other texts.
        scanned = [[self.ends(*p, a, b) for p, a, b in self.scanned(arr[i].as_py(), chunk)] for i in long]
        between = pa.array([x[1].replace(MARK, " ") for parts in scanned for x in parts], arr.type)
        ids, at = self._plainly(pa.concat_arrays([pc.if_else(pa.array(size > chunk), pa.scalar("", arr.type), marked), between]))
        out, last, k, count = [], 0, len(arr), np.diff(at[: len(arr) + 1])
        for i, parts in zip(long, scanned, strict=True):
            out.append(ids[at[last] : at[i]])
            whole = []
            for head, _, tail in parts:
                whole += [head, ids[at[k] : at[k + 1]], tail]
                k += 1
            out += whole
            count[i], last = sum(map(len, whole)), i
        out.append(ids[at[last] : at[len(arr)]])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(count)]), -(-size // chunk)

    def _plainly(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin and end at hard bounds, blanks standing for marks, and where each text's begin."""
        buf, offs = tokens.column(marked)
        buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        bounds = self.bounds(buf, offs)
        ids, at = self.segmented(buf, bounds)
        return ids, at[np.searchsorted(bounds, offs)]

    def scanned(self, text: str, chunk: int) -> Iterator[tuple[tuple[str, int, int], tuple[int, int], tuple[int, int]]]:
        """The chunks of a text with the states on the best path at both ends of each."""
        parts = list(self.parts(self.escape(text), chunk))
        moves = [self.transfer(*p) for p in parts]
        at = scan([m[2] for m in moves])
        for k, (p, m) in enumerate(zip(parts, moves, strict=True)):
            yield p, m[0][at[k]], m[1][at[k + 1]]

    def parts(self, text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
        """The chunks of an escaped text, each with `longest` more characters on either side, and where it begins and ends there."""
        for a in range(0, len(text), chunk):
            low, b = max(0, a - self.longest), min(a + chunk, len(text))
            yield text[low : b + self.longest], a - low, b - low

    def numbers(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(text)

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts that runs of ids stand for; at is where each run begins (one more at the end)."""
        data, ends = gathered(self._byte_pool, self._byte_starts[ids], self._byte_sizes[ids])
        offs = ends[at]
        if self.prefix and len(data):
            some = np.flatnonzero(np.diff(offs))
            some = some[data[offs[some]] == 32]
            data = np.delete(data, offs[some])
            gone = np.zeros(len(offs), np.int64)
            gone[some + 1] = 1
            offs = offs - np.cumsum(gone)
        out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.large_string())
        return out

    def encode(self, text: str) -> list[int]:
        """One chunk: hard bounds at both ends, a scalar for each segment."""
        return self.encoded(pa.array([text]), sys.maxsize)[0].tolist()

    # Chunks of a longer text: the text of a chunk comes with `longest` more characters on either side.

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """What may cross place at of text or end there; (at, at) alone where no piece can cross and pairs do not matter."""
        if at <= 0 or at >= len(text) or self._hard(text, at):
            return [(at, at)]
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in range(at, min(s + self.longest, len(text)) + 1) if (e - s == 1 or text[s:e] in self.ids) and self.edge(text[s:e]) > NONE and not self._crosses(text, s, e)]

    def _hard(self, text: str, at: int) -> bool:
        a, b = text[at - 1], text[at]
        return a in self.alone or b in self.alone or (b == MARK and a != MARK)

    def _crosses(self, text: str, s: int, e: int) -> bool:
        return any(self._hard(text, p) for p in range(s + 1, e))

    def transfer(self, text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """States at a and at b, and the best scores from one to the other over pieces that start in [a, b)."""
        left, right = self.states(text, a), self.states(text, b)
        first = next((p for p in range(a, b) if not p or self._hard(text, p)), None)
        out = np.full((len(left), len(right)), NONE)
        if first is None:
            best, _ = self.lattice(text, left, b)
            for j, s in enumerate(right):
                got = best.get(s) if s[0] < s[1] else self._ended(best, s[1])
                if got is not None:
                    out[:, j] = got
            return left, right, out
        # Hard bounds inside part the chunk: what is before the first and after the last are the factors of a matrix of rank one.
        last = next(p for p in range(b - 1, a - 1, -1) if not p or self._hard(text, p))
        head = np.zeros(len(left))
        if first > a:
            best, _ = self.lattice(text[:first], [s for s in left if s[1] <= first], first)
            got = self._ended(best, first)
            head = np.array([NONE] * len(left))
            head[[k for k, s in enumerate(left) if s[1] <= first]] = got
        middle = 0.0 if self.bpe else float(self._scores[self.plain(text[first:last])].sum())
        best, _ = self.lattice(text, [(last, last)], b)
        tail = np.array([(best[s][0] if s in best else NONE) if s[0] < s[1] else self._ended(best, s[1])[0] for s in right])
        return left, right, head[:, None] + middle + tail[None, :]

    @staticmethod
    def _ended(best: dict, at: int) -> np.ndarray:
        return np.max([v for s, v in best.items() if s[1] == at] or [np.full(len(next(iter(best.values()))), NONE)], axis=0)

    def ends(self, text: str, a: int, b: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[np.ndarray, str, np.ndarray]:
        """Of the pieces that start in [a, b), given the states at both cuts: ids up to the first hard bound, the text from it to
        the last one, ids from there."""
        low = max(a, left[1])
        first = next((p for p in range(low, b) if not p or self._hard(text, p)), None)
        if first is None:
            return np.array(self.numbers(self.path(text, left, right) if right[0] < right[1] else self.path(text[: right[1]], left)), np.int32), "", np.zeros(0, np.int32)
        last = next(p for p in range(b - 1, low - 1, -1) if not p or self._hard(text, p))
        head = self.numbers(self.path(text[:first], left)) if first > left[1] else []
        end = right if right[0] < right[1] else None
        tail = self.numbers(self.path(text if end else text[: right[1]], (last, last), end))
        return np.array(head, np.int32), text[first:last], np.array(tail, np.int32)

    def trace(self, text: str, a: int, b: int, left: tuple[int, int], right: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces that start in [a, b), given the states at both cuts."""
        head, between, tail = self.ends(text, a, b, left, right)
        return np.concatenate([head, self.plain(between), tail])


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices under maximum and plus."""
    return (x[:, :, None] + y[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path: products of all beginnings, by doubling, then one look back from the end."""
    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [combine(prefix[i - step], m) if i >= step else m for i, m in enumerate(prefix)]
        step *= 2
    at = [0] * (len(matrices) + 1)
    for i in range(len(matrices) - 1, 0, -1):
        at[i] = int((prefix[i - 1][0] + matrices[i][:, at[i + 1]]).argmax())
    return at


def _model(blob: bytes) -> Model:
    """The model of this worker process, kept from task to task with what it remembers."""
    kept = vars(sys).setdefault("_agora_models", {})
    key = hashlib.sha256(blob).digest()
    if key not in kept:
        kept[key] = Model(blob)
    return kept[key]


def load(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def _lists(ids: np.ndarray, at: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(nulls) if len(nulls) else None)


def _encode_short(blob: bytes, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob)
        for batch in batches:
            for part in tokens.slices(batch, size=SLICE):
                text = part.column("text")
                ids, at, chunks = m.encoded(text, chunk)
                nulls = ~text.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, at, nulls), pa.array(chunks, pa.int64())], names=[*part.schema.names, "ids", "n_chunks"])

    return run


def _split(blob: bytes, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob)
        for batch in batches:
            for row, text in zip(batch.column("_row"), batch.column("text"), strict=True):
                for k, (t, a, b) in enumerate(m.parts(m.escape(text.as_py()), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([t]), pa.array([a], pa.int32()), pa.array([b], pa.int32())], names=["_row", "k", "text", "a", "b"])

    return run


def _transfers(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob)
        for batch in batches:
            out = [pickle.dumps(m.transfer(t, a, b)) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("k"), pa.array(out, pa.binary())], names=["_row", "k", "t"])

    return run


def _states(table: pa.Table) -> pa.Table:
    """The states on the best path at both ends of each chunk of one text."""
    table = table.sort_by("k")
    got = [pickle.loads(x) for x in table.column("t").to_pylist()]
    at = scan([g[2] for g in got])
    ends = [(*g[0][at[i]], *g[1][at[i + 1]]) for i, g in enumerate(got)]
    return pa.table([table.column("_row"), table.column("k"), pa.array(ends, pa.list_(pa.int32()))], names=["_row", "k", "ends"])


def _traces(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b", "ends")), strict=True)
            ids = [m.trace(t, a, b, (e[0], e[1]), (e[2], e[3])) for t, a, b, e in rows]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["_row", "k", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """docs with ids (array<int>) and n_chunks (long); columns of those names are replaced, all others stay.

    Null texts give null ids and no chunk, empty texts no ids and no chunk. A word mark in a text counts as a blank, as in the
    library. Repeated rows come back as often as they came. An empty table gives no rows. model_path: a SentencePiece model
    that keeps texts as they are, on any file system that Spark reads. The chunks of texts of spread bytes or more are dealt out.
    """
    spark = docs.sparkSession
    blob = load(bounded(spark), model_path)
    docs = docs.drop("ids", "n_chunks")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", ids array<int>, n_chunks long"
    long = F.coalesce(F.octet_length("text") >= spread, F.lit(False))
    short = docs.where(~long).mapInArrow(tidied(_encode_short(blob, chunk)), shape)
    row = fresh(docs, "_row")
    giants = cut(docs.where(long).withColumn(row, F.monotonically_increasing_id()), "giants")
    chunks = cut(giants.select(F.col(row).alias("_row"), "text").mapInArrow(tidied(_split(blob, chunk)), "_row long, k int, text string, a int, b int").repartition(F.col("_row"), F.col("k")), "chunks")
    ends = chunks.mapInArrow(tidied(_transfers(blob)), "_row long, k int, t binary").groupBy("_row").applyInArrow(_states, "_row long, k int, ends array<int>")
    traced = chunks.join(ends, ["_row", "k"]).select("_row", "k", "text", "a", "b", "ends").mapInArrow(tidied(_traces(blob)), "_row long, k int, ids array<int>")
    whole = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"), F.count("*").alias("n_chunks"))
    found = giants.join(whole.withColumnRenamed("_row", row), row)
    return short.union(found.select(*docs.columns, "ids", "n_chunks"))


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (ids array<int>) with text (string) replaced or added: what the ids stand for. Null ids give null text."""
    blob = load(bounded(rows.sparkSession), model_path)
    rows = rows.drop("text")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, begins, valid = _runs(part.column("ids"))
                text = pc.if_else(valid, m.decoded(ids, begins), pa.scalar(None, pa.large_string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=[*part.schema.names, "text"])

    return rows.mapInArrow(tidied(run), shape)


def _runs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The numbers of a column of lists, where each list's begin (one more at the end), and which lists are not null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lists.is_valid()


def digests(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_chunks, ids_sha256, exact): the digest of the ids as 32-bit little-endian numbers, and whether
    they decode to the text again. rows: doc_id, text, ids, n_chunks; null texts count as empty and null ids as none, a null
    doc_id stays null. Repeated rows come back as often as they came. An empty table gives no rows."""
    blob = load(bounded(rows.sparkSession), model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(blob)
        for batch in batches:
            for part in tokens.slices(batch, size=1 << 20):
                text = part.column("text").fill_null("").cast(pa.large_string())
                ids, at, _ = _runs(part.column("ids"))
                raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                exact = pc.equal(m.decoded(ids, at), text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.utf8_length(text).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), part.column("n_chunks"), pa.array(sha, pa.string()), exact], names=["doc_id", "n_chars", "n_tokens", "n_chunks", "ids_sha256", "exact"])

    return rows.select("doc_id", "text", "ids", "n_chunks").mapInArrow(tidied(run), "doc_id long, n_chars long, n_tokens long, n_chunks long, ids_sha256 string, exact boolean")
