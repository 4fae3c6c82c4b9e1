"""Operator 10: SentencePiece encoding by a max-plus scan over chunks, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import durable, partitions, pick
from lociframe.llm.words import filled, mix, portions

SPACE = "▁"
#: Characters of a chunk; a text of more than one chunk is giant and is cut.
CHUNK = 1 << 15
#: Chunks of giant texts that a task solves, about.
CHUNKS_A_TASK = 64
#: Stretches whose paths a task keeps; a cache only, results don't depend on it.
CACHED = 300_000
NEVER = float("-inf")
#: Characters from which a word is cut at its boundaries before it is solved.
LONG = 64
_ONE = [1]
_WORDS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


@dataclass
class Vocabulary:
    """What encoding needs of a model: pieces of text with their scores, ids, byte pieces, and the kind of its paths."""

    kind: str  # "bpe" or "unigram"
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]  # empty without byte fallback
    unknown: int
    table: list[bytes]  # what each id decodes to
    name: int = 0  # tells models apart

    def __post_init__(self) -> None:
        self.name = zlib.crc32(repr((self.kind, sorted(self.scores.items()), self.byte_ids, self.unknown)).encode())

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("a  b\tＡ") != f"{SPACE}a{SPACE}{SPACE}b\tＡ":
            raise ValueError("only models that leave texts as they are, but for spaces and one space before, are read")
        ids, scores, bytes_, table = {}, {}, {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[1:-1], 16)] = i
                table.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                table.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                ids[piece], scores[piece] = i, sp.get_score(i)
                table.append(piece.replace(SPACE, " ").encode())
        merges = sorted(scores.values())
        kind = "bpe" if all(s == int(s) for s in merges) and max(merges, default=0) <= 0 else "unigram"
        return cls(kind, ids, scores, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], sp.unk_id(), table)


def merged(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """The definition of a BPE path: join the neighbours whose union scores highest, leftmost first, until none is a piece."""
    symbols = list(symbols)
    while True:
        best, at = NEVER, -1
        for i in range(len(symbols) - 1):
            s = scores.get(symbols[i] + symbols[i + 1], NEVER)
            if s > best:
                best, at = s, i
        if at < 0:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Lattice:
    """Paths of pieces through a text, weighed in the max-plus semiring.

    A unigram path weighs the sum of its pieces' scores. A BPE path weighs 0 if merging could have made it and
    minus infinity if not; by the locality of merging that is so exactly if each two neighbours, merged by
    themselves, stay as they are, so a path's weight is a sum over neighbours, and one path of a whole text is left.

    The state at a place is the piece that holds the character before it: where it begins and ends. A chunk of text
    has a matrix from the states at its front to those at its back; matrices multiply by (max, +), which is
    associative. Where two neighbouring characters lie together in no piece, each path has a boundary: one state
    at which the matrix is 1 x 1, so stretches between such places are solved by themselves, and once if
    they recur.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        scores = vocabulary.scores
        self.bpe = vocabulary.kind == "bpe"
        self.pieces = {p: (0.0 if self.bpe else s) for p, s in scores.items() if not self.bpe or len(p) == 1 or merged(list(p), scores) == [p]}
        self.longest = max(map(len, self.pieces), default=1)
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.lengths_by_start: dict[str, list[int]] = {}
        for p in self.pieces:
            self.lengths_by_start.setdefault(p[:2], []).append(len(p))
        self.lengths_by_end: dict[str, list[int]] = {}
        for p in self.pieces:
            if len(p) > 1:
                self.lengths_by_end.setdefault(p[-2:], []).append(len(p))
        for d in (self.lengths_by_start, self.lengths_by_end):
            for k, n in d.items():
                d[k] = sorted({*n, *([1] if d is self.lengths_by_start else [])}, reverse=True)
        self.unknown_score = min(scores.values(), default=0.0) - 10
        self.agree: dict[tuple[str, str], bool] = {}
        self.paths: dict[str, list[int]] = {}
        self.newline = not any("\n" in p for p in self.pieces)
        self.spaced = not any(b[1] == SPACE != b[0] for b in self.joined)  # a space after something else is a boundary

    # Weights

    def follows(self, a: str, b: str) -> bool:
        """May piece b come after piece a on a path?"""
        if not self.bpe:
            return True
        found = self.agree.get((a, b))
        if found is None:
            if len(self.agree) > 1_000_000:
                self.agree.clear()
            found = self.agree[a, b] = a[-1] + b[0] not in self.joined or merged([*a, *b], self.v.scores) == [a, b]
        return found

    def weight(self, piece: str) -> float:
        return self.pieces.get(piece, 0.0 if self.bpe else self.unknown_score)

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a place, longest first; the character alone if it is in none."""
        out = [text[at : at + n] for n in self.lengths_by_start.get(text[at : at + 2], ()) if text[at : at + n] in self.pieces and at + n <= len(text)]
        return out if out and len(out[-1]) == 1 else [*out, text[at]]

    def ids_of(self, piece: str) -> list[int]:
        found = self.v.ids.get(piece)
        if found is not None:
            return [found]
        return [self.v.byte_ids[b] for b in piece.encode()] if self.v.byte_ids else [self.v.unknown]

    # One stretch, whole

    def solve(self, text: str) -> list[str]:
        """The best path from a boundary at the front of ``text`` to one at its back; ties go to longer last pieces."""
        if self.bpe:
            return self._only_path(text)
        last: list[str] = [""]
        best = [0.0]
        for e in range(1, len(text) + 1):
            chosen, value = None, NEVER
            for n in [*self.lengths_by_end.get(text[e - 2 : e], ()), 1] if e > 1 else [1]:
                piece = text[e - n : e] if n <= e else ""
                if not piece or n > 1 and piece not in self.pieces:
                    continue
                w = best[e - n] + self.weight(piece)
                if w > value:
                    chosen, value = piece, w
            last.append(chosen)
            best.append(value)
        out, e = [], len(text)
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def _only_path(self, text: str) -> list[str]:
        """The one BPE path of weight 0: longest pieces first, back where none may follow. A state that failed isn't tried again."""
        starts, pieces, agree = self.lengths_by_start, self.pieces, self.agree
        path: list[str] = []
        tried: list[int] = []
        dead: set[tuple[int, str]] = set()
        at, n, prev, skip = 0, len(text), "", 0
        while at < n:
            lengths = starts.get(text[at : at + 2], _ONE)
            found = None
            for k in range(skip, len(lengths)):
                size = lengths[k]
                piece = text[at : at + size]
                if (size > 1 and (piece not in pieces or at + size > n)) or (prev and not (agree[prev, piece] if (prev, piece) in agree else self.follows(prev, piece))):
                    continue
                if dead and (at + size, piece) in dead:
                    continue
                found = piece
                break
            if found is not None:
                path.append(found)
                tried.append(k)
                at += size
                prev, skip = found, 0
                continue
            dead.add((at, prev))
            prev = path.pop()
            at -= len(prev)
            skip = tried.pop() + 1
            prev = path[-1] if path else ""
        return path

    def stretch(self, text: str) -> list[int]:
        ids = self.paths.get(text)
        if ids is None:
            known = self.v.ids
            ids = []
            for p in self.solve(text):
                if p in known:
                    ids.append(known[p])
                else:
                    ids += self.ids_of(p)
            if len(text) <= LONG:
                if len(self.paths) >= CACHED:
                    self.paths.clear()
                self.paths[text] = ids
        return ids

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Places p, low <= p <= high, between characters that no piece joins."""
        joined = self.joined
        return [p for p in range(max(low, 1), min(high, len(text) - 1) + 1) if text[p - 1 : p + 1] not in joined]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text without chunks."""
        cuts = [0, *self.boundaries(text, 1, len(text) - 1), len(text)]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.stretch(text[a:b])]

    # Chunks

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(begin, end) of the pieces that may hold the character before ``at``, seen from the text around it."""
        if at == 0:
            return [(0, 0)]
        if at == len(text) or text[at - 1 : at + 1] not in self.joined:
            out = [(b, at) for b in range(max(0, at - self.longest), at - 1) if text[b:at] in self.pieces]
            return [*out, (at - 1, at)]
        out = [(b, b + len(p)) for b in range(max(0, at - self.longest), at) for p in self.starting(text, b) if b + len(p) >= at]
        return out

    def scan(self, text: str, low: int, high: int, fronts: list[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[float, tuple | None]]]:
        """Weights of the best paths from each front state to each (begin, end) with begin < high <= end, with the state before."""
        n = len(fronts)
        nodes: dict[int, dict[tuple[int, int], list]] = {}
        for k, f in enumerate(fronts):
            row = nodes.setdefault(max(f[1], low), {}).setdefault(f, [(NEVER, None)] * n)
            row[k] = (0.0, None)
        out: dict[tuple[int, int], list] = {}
        done: dict[tuple[int, int], list] = {}
        for f in fronts:
            if f[1] >= high:
                out[f] = nodes[max(f[1], low)][f]
        for p in range(low, high):
            here = nodes.pop(p, None)
            if not here:
                continue
            done |= here
            for piece in self.starting(text, p):
                w, new = self.weight(piece), [(NEVER, None)] * n
                for state, row in here.items():
                    if state[0] == state[1] or self.follows(text[state[0] : state[1]], piece):
                        new = [(r[0] + w, state) if r[0] + w > x[0] else x for r, x in zip(row, new)]
                if any(x[0] > NEVER for x in new):
                    state = (p, p + len(piece))
                    if state[1] >= high:
                        out[state] = new
                    else:
                        nodes.setdefault(state[1], {})[state] = new
        self._done = done
        return out

    def _inside(self, text: str, low: int, high: int, fronts: list[tuple[int, int]]) -> tuple[int, int] | None:
        """The first and the last boundary of a chunk that lie between all its front and back states."""
        after = max([low, *(f[1] for f in fronts)])
        first = self._boundary(text, range(max(after, 1), min(high, len(text) - 1) + 1))
        return None if first is None else (first, self._boundary(text, range(min(high, len(text) - 1), first - 1, -1)))

    def _boundary(self, text: str, places: range) -> int | None:
        """The first boundary among ``places``."""
        return next((p for p in places if text[p - 1 : p + 1] not in self.joined), None)

    def _between(self, text: str, many: ManyPaths | None) -> list[int]:
        """Ids of a text from one boundary to another: those of its words, distinct ones solved once."""
        if many is None or not self.newline or not self.spaced:
            cuts = [0, *self.boundaries(text, 1, len(text) - 1), len(text)]
            return [i for a, b in zip(cuts, cuts[1:]) for i in self.stretch(text[a:b])]
        words = _WORDS.findall(text)
        number = {w: i for i, w in enumerate(dict.fromkeys(w for w in words if w != "\n"))}
        ids, count = many.solve(list(number))
        own = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if number else []
        line = self.ids_of("\n")
        return [i for w in words for i in (line if w == "\n" else own[number[w]])]

    def transfer(self, text: str, low: int, high: int) -> tuple[list, list, list[list[float]]]:
        """Front states, back states and matrix of the chunk text[low:high]; ``text`` has a margin of the longest piece on both sides."""
        fronts = self.states(text, low)
        backs = self.states(text, high)
        sync = self._inside(text, low, high, fronts)
        if sync is None:
            got = self.scan(text, low, high, fronts)
            return fronts, backs, [[got[b][k][0] if b in got else NEVER for b in backs] for k in range(len(fronts))]
        first, last = sync
        head = self.scan(text, low, first, fronts)
        to_first = [max([row[k][0] for row in head.values()], default=NEVER) for k in range(len(fronts))]
        middle = 0.0
        if not self.bpe:
            cuts = self.boundaries(text, first, last)
            middle = sum(self.weight(p) for a, b in zip(cuts, cuts[1:]) for p in self.solve(text[a:b]))
        if last == high:
            tail_from = self._boundary(text, range(high - 1, first - 1, -1)) if high > first else first
            tail = {(high - len(p), high): w for p, w in [self._last_piece(text[tail_from:high])]} if high > first else {}
            if not tail:  # all of the chunk lies before its only boundary
                return fronts, backs, [[head[b][k][0] if b in head else NEVER for b in backs] for k in range(len(fronts))]
        else:
            got = self.scan(text, last, high, [(last, last)])
            tail = {b: row[0][0] for b, row in got.items()}
        return fronts, backs, [[to_first[k] + middle + tail.get(b, NEVER) for b in backs] for k in range(len(fronts))]

    def _last_piece(self, text: str) -> tuple[str, float]:
        return self.solve(text)[-1], 0.0

    def backtrace(self, text: str, low: int, high: int, front: tuple[int, int], back: tuple[int, int], many: ManyPaths | None = None) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the best path between two states."""
        sync = self._inside(text, low, high, [front])
        if sync is None:
            return self._walk(text, low, high, front, back)
        first, last = sync
        head = self.scan(text, low, first, [front])
        ids = self._walk(text, low, first, front, max(head, key=lambda s: head[s][0][0])) if first > max(low, front[1]) else []
        if last > first:
            ids += self._between(text[first:last], many)
        return ids if last == high else ids + self._walk(text, last, high, (last, last), back)

    def _walk(self, text, low, high, front, back) -> list[int]:
        if back == front:
            return []
        got = self.scan(text, low, high, [front])
        done, state, pieces = self._done, back, []
        row = got[back]
        while state != front:
            pieces.append(text[state[0] : state[1]])
            state = row[0][1]
            row = done[state]
        return [i for p in reversed(pieces) for i in self.ids_of(p)]


class ManyPaths:
    """:meth:`Lattice._only_path` for many words at once: each step adds a piece to every word that isn't done, or takes its last one back.

    Pieces are looked up by a 64-bit hash of their characters in an open table, pairs of ids in a sorted list that grows
    as new pairs are met. Words that hold a character outside the vocabulary, are long, or take many steps are left to
    the lattice.
    """

    _P = np.uint64(0x9E3779B97F4A7C15)
    _BITS = 18

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice
        self.names = list(lattice.pieces)
        self.power = self._P ** np.arange(lattice.longest + 1, dtype=np.uint64)
        self.ids = np.array([lattice.v.ids[p] for p in self.names], np.int64)
        self.keys = np.zeros(1 << self._BITS, np.uint64)
        self.at = np.full(1 << self._BITS, -1, np.int64)
        for i, p in enumerate(self.names):
            h = 0
            for c in self._mixed(np.array([ord(c) for c in p])):
                h = (h * int(self._P) + int(c)) & (2**64 - 1)
            slot = self._slot(h)
            while self.at[slot] >= 0:
                slot = (slot + 1) % len(self.at)
            self.keys[slot], self.at[slot] = h, i
        self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    @staticmethod
    def _mixed(codes: np.ndarray) -> np.ndarray:
        return mix(codes.astype(np.uint64) + np.uint64(1))

    def _slot(self, h):
        if isinstance(h, int):
            return (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64 >> (64 - self._BITS)
        return (((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def _look(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        slot = self._slot(h)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            there = self.at[slot[left]]
            same = (there >= 0) & (self.keys[slot[left]] == h[left])
            out[left[same]] = there[same]
            left = left[(there >= 0) & ~same]
            slot[left] = (slot[left] + 1) % len(self.at)
        return out

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.names) + b
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        if not known.all():
            new = np.unique(key[~known])
            good = np.array([self.lattice.follows(self.names[k // len(self.names)], self.names[k % len(self.names)]) for k in new.tolist()])
            self.lattice.agree.clear()
            if len(self.pairs) > 4_000_000:
                self.pairs, self.good = self.pairs[:0], self.good[:0]
                return self._follow(a, b)
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.good = np.insert(self.pairs, at, new), np.insert(self.good, at, good)
            at = np.searchsorted(self.pairs, key)
        return self.good[at]

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        c = self._mixed(codes)
        end = np.cumsum(size)
        at, last = end - size, np.full(len(words), -1, np.int64)
        hard = size >= LONG
        going = np.flatnonzero((size > 0) & ~hard)
        lengths = np.array([len(p) for p in self.names], np.int64)
        span = self.lattice.longest
        stack = np.zeros((len(words), int(size[~hard].max()) if len(going) else 0), np.int32)
        depth, limit = np.zeros(len(words), np.int64), np.full(len(words), span)
        for _ in range(6 * LONG):
            if not len(going):
                break
            here, room = at[going], np.minimum(end[going] - at[going], limit[going])
            best = np.full(len(going), -1, np.int64)
            # Hashes of the 1, 2, ... characters from a place, made longer by one at a time.
            h = np.zeros(len(going), np.uint64)
            found = np.full((int(room.max()), len(going)), -1, np.int32)
            rows = np.arange(len(going))
            for n in range(1, len(found) + 1):
                rows = rows[room[rows] >= n]
                h[rows] = h[rows] * self._P + c[here[rows] + n - 1]
                found[n - 1, rows] = self._look(h[rows])
                if n == 2:  # nothing longer begins with two characters that begin no piece
                    rows = rows[self.begins(codes[here[rows]], codes[here[rows] + 1])]
            for n in range(len(found), 0, -1):
                rows = np.flatnonzero((best < 0) & (found[n - 1] >= 0))
                if len(rows):
                    before, piece = last[going[rows]], found[n - 1, rows].astype(np.int64)
                    fit = before < 0
                    fit[~fit] = self._follow(before[~fit], piece[~fit])
                    best[rows[fit]] = piece[fit]
            on, piece = going[best >= 0], best[best >= 0]
            stack[on, depth[on]] = piece
            depth[on] += 1
            at[on] += lengths[piece]
            last[on], limit[on] = piece, span
            back = going[best < 0]
            lost = depth[back] == 0
            hard[back[lost]] = True
            back = back[~lost]
            depth[back] -= 1
            size_back = lengths[stack[back, depth[back]]]
            at[back] -= size_back
            limit[back] = size_back - 1
            last[back] = np.where(depth[back] > 0, stack[back, np.maximum(depth[back] - 1, 0)], -1)
            none = back[limit[back] == 0]
            while len(none):  # a single character was taken back: so must be what is before it
                lost = depth[none] == 0
                hard[none[lost]] = True
                none = none[~lost]
                depth[none] -= 1
                size_back = lengths[stack[none, depth[none]]]
                at[none] -= size_back
                limit[none] = size_back - 1
                last[none] = np.where(depth[none] > 0, stack[none, np.maximum(depth[none] - 1, 0)], -1)
                none = none[limit[none] == 0]
            going = going[(at[going] < end[going]) & ~hard[going]]
        hard[going] = True
        own = [self.lattice.encode(words[i]) for i in np.flatnonzero(hard)]
        count = np.where(hard, 0, depth)
        count[hard] = [len(x) for x in own]
        out = np.zeros(int(count.sum()), np.uint32)
        soft = np.arange(stack.shape[1])[None, :] < np.where(hard, 0, depth)[:, None]
        place = np.repeat(~hard, count)
        out[place] = self.ids[stack[soft]]
        out[~place] = [i for x in own for i in x]
        return out, count

    def begins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_starts"):
            self._starts = np.unique(np.array([ord(p[0]) << 21 | ord(p[1]) for p in self.names if len(p) > 2] or [0], np.int64))
        key = a.astype(np.int64) << 21 | b
        at = np.minimum(np.searchsorted(self._starts, key), len(self._starts) - 1)
        return self._starts[at] == key


_MADE: dict[int, tuple[Lattice, ManyPaths | None]] = {}


def made(vocabulary: Vocabulary) -> tuple[Lattice, ManyPaths | None]:
    """A model's lattice and word solver, made once in a Python worker and kept for its later tasks."""
    if vocabulary.name not in _MADE:
        _MADE.clear()
        lattice = Lattice(vocabulary)
        _MADE[vocabulary.name] = lattice, ManyPaths(lattice) if lattice.bpe else None
    return _MADE[vocabulary.name]


def multiply(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """The product of two matrices by (max, +)."""
    return [[max((x + y for x, y in zip(row, column, strict=True)), default=NEVER) for column in zip(*b, strict=True)] for row in a]


def choose_states(chunks: list[tuple[list, list, list[list[float]]]]) -> list[int]:
    """The state at each chunk's back on the best path of the whole text, as its number there.

    Prefix products of the matrices give the best weight of each state at each back; the best one of the last chunk
    is then followed forward to the front. The text's end is a boundary.
    """
    prefix, at = [], None
    for _, _, matrix in chunks:
        at = matrix if at is None else multiply(at, matrix)
        at = [[max(row[j] for row in at) for j in range(len(at[0]))]]
        prefix.append(at[0])
    chosen = [max(range(len(prefix[-1])), key=lambda j: prefix[-1][j])]
    for k in range(len(chunks) - 1, 0, -1):
        matrix, to = chunks[k][2], chosen[-1]
        chosen.append(max(range(len(matrix)), key=lambda i: prefix[k - 1][i] + matrix[i][to]))
    return chosen[::-1]


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode_batch(lattice: Lattice, texts: pa.Array, many: ManyPaths | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts (no nulls) end to end, and their number for each."""
    # A text whose spaces stand alone is the stretches between them, each space with the word after it; a line
    # end is in no piece, so what follows one is a stretch without a space. Others take the general way.
    odd = pc.match_substring_regex(texts, f"^ |  | $|{SPACE}").to_numpy(zero_copy_only=False).astype(bool)
    if not lattice.newline:
        odd[:] = True
    plain = pc.if_else(pa.array(odd), "", texts)
    lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    tokens = lists.flatten().dictionary_encode()
    names = tokens.dictionary.to_pylist()
    line = np.fromiter((t.startswith("\n") for t in names), bool, len(names))
    words = [t[1:] if x else SPACE + t for t, x in zip(names, line.tolist(), strict=True)]
    if many is not None:
        flat, size = many.solve(words)
    else:
        table = [lattice.encode(w) for w in words]
        size = np.fromiter(map(len, table), np.int64, len(table))
        flat = np.fromiter((i for x in table for i in x), np.uint32, int(size.sum()))
    # The ids of a line end go before those of what follows it.
    head = np.array(lattice.ids_of("\n"), np.uint32)
    first = np.cumsum(size) - size
    if line.any():
        flat = np.insert(flat, np.repeat(first[line], len(head)), np.tile(head, int(line.sum())))
        size = size + line * len(head)
        first = np.cumsum(size) - size
    code, doc = tokens.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    blank = pc.equal(texts, "").to_numpy(zero_copy_only=False).astype(bool) | odd
    use = ~blank[doc]
    code, doc = code[use], doc[use]
    n = size[code]
    ids = flat[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    count = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
    if odd.any():
        parts, at = [], np.cumsum(count) - count
        for i in range(len(texts)):
            if odd[i]:
                parts.append(np.array(lattice.encode(prepared(texts[i].as_py())), np.uint32))
                count[i] = len(parts[-1])
            else:
                parts.append(ids[at[i] : at[i] + count[i]])
        ids = np.concatenate(parts)
    return ids, count


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoder(vocabulary, columns: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, many = made(vocabulary.value)
        for batch in portions(batches, "_text", 4 << 20):
            ids = _lists(*encode_batch(lattice, filled(batch.column("_text")), many))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), ids], names=[*columns, "ids"])

    return run


def _cutter(chunk: int, margin: int) -> object:
    """Chunks of each text with ``margin`` characters on either side, cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text"), strict=True):
                whole = SPACE + text.as_py().replace(" ", SPACE)
                begins = range(0, len(whole), chunk)
                for first in range(0, len(begins), 64):
                    group = begins[first : first + 64]
                    skips = [max(0, a - margin) for a in group]
                    highs = [min(a + chunk, len(whole)) for a in group]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(group), pa.int64()),
                            pa.array([a // chunk for a in group], pa.int32()),
                            pa.array([whole[skip : high + margin] for skip, high in zip(skips, highs, strict=True)]),
                            pa.array([a - skip for a, skip in zip(group, skips, strict=True)], pa.int32()),
                            pa.array([high - skip for high, skip in zip(highs, skips, strict=True)], pa.int32()),
                            pa.array(skips, pa.int64()),
                        ],
                        names=["_row", "k", "part", "low", "high", "skip"],
                    )

    return run


def _pack(states: list) -> list[int]:
    return [x for s in states for x in s]


def _transfers(vocabulary) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = made(vocabulary.value)
        for batch in batches:
            rows = []
            for text, low, high, skip in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "skip")), strict=True):
                fronts, backs, matrix = lattice.transfer(text, low, high)
                whole = lambda states, skip=skip: _pack([(b + skip, e + skip) for b, e in states])
                rows.append((whole(fronts), whole(backs), [x for r in matrix for x in r]))
            a, b, m = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("k"), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array(m, pa.list_(pa.float64()))], names=["_row", "k", "fronts", "backs", "matrix"])

    return run


def _choose(table: pa.Table) -> pa.Table:
    """The states of one text's chunks, from their matrices alone."""
    table = table.sort_by("k")
    chunks = []
    for f, b, m in zip(*(table[c].to_pylist() for c in ("fronts", "backs", "matrix")), strict=True):
        fronts, backs = list(zip(f[::2], f[1::2], strict=True)), list(zip(b[::2], b[1::2], strict=True))
        chunks.append((fronts, backs, [m[i * len(backs) : (i + 1) * len(backs)] for i in range(len(fronts))]))
    chosen = [c[1][j] for c, j in zip(chunks, choose_states(chunks), strict=True)]
    before = [chunks[0][0][0], *chosen[:-1]]
    flat = {"front_begin": [s[0] for s in before], "front_end": [s[1] for s in before], "back_begin": [s[0] for s in chosen], "back_end": [s[1] for s in chosen]}
    return pa.table({"_row": table["_row"], "k": table["k"], **{n: pa.array(v, pa.int64()) for n, v in flat.items()}})


def _traces(vocabulary) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, many = made(vocabulary.value)
        for batch in batches:
            out = []
            for text, low, high, skip, fb, fe, bb, be in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "skip", "front_begin", "front_end", "back_begin", "back_end")), strict=True):
                out.append(lattice.backtrace(text, low, high, (fb - skip, fe - skip), (bb - skip, be - skip), many))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("k"), pa.array(out, pa.list_(pa.int32()))], names=["_row", "k", "ids"])

    return run


def encode_texts(docs: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, text, ids): ids of every whole text, as the model's own library gives them.

    Texts of up to ``chunk`` characters are solved where they lie. Longer ones become a row a chunk: each chunk's matrix
    is made by itself, a text's matrices (a few hundred numbers each) meet and fix the states at the chunk ends, and
    each chunk is traced back between its two states by itself.

    Null and empty texts have no ids. Null and repeated keys stay, one row a row; an empty table gives an empty
    one; other columns are left out.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # bounded by the model
    rows = pick(docs, key, text).toDF("_id", "_text")
    kind = rows.schema["_id"].dataType.simpleString()
    long_ = F.length("_text") > chunk
    short = rows.where(F.col("_text").isNull() | ~long_).mapInArrow(_encoder(shared, ["_id", "_text"]), f"_id {kind}, _text string, ids array<int>")
    giant = durable(rows.where(long_).withColumn("_row", F.monotonically_increasing_id()), "giant")
    if giant.isEmpty():
        return short.select(F.col("_id").alias(key), F.col("_text").alias(text), "ids")
    margin = max(map(len, shared.value.ids), default=1)
    chunks = giant.agg(F.sum(F.ceil((F.length("_text") + 1) / chunk))).first()[0]
    tasks = max(partitions(docs.sparkSession), -(-chunks // CHUNKS_A_TASK))  # fixed: chunks are light in bytes and heavy in work
    cut = giant.select("_row", "_text").mapInArrow(_cutter(chunk, margin), "_row bigint, k int, part string, low int, high int, skip bigint")
    parts = cut.repartition(tasks, "_row", "k")
    matrices = parts.mapInArrow(_transfers(shared), "_row bigint, k int, fronts array<bigint>, backs array<bigint>, matrix array<double>")
    states = matrices.groupBy("_row").applyInArrow(_choose, "_row bigint, k int, front_begin bigint, front_end bigint, back_begin bigint, back_end bigint")
    traced = parts.join(states, ["_row", "k"]).mapInArrow(_traces(shared), "_row bigint, k int, ids array<int>")
    joined = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    out = short.unionByName(giant.join(joined, "_row").select("_id", "_text", "ids"))
    return out.select(F.col("_id").alias(key), F.col("_text").alias(text), "ids")


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """The text of ids; bytes that form no character become U+FFFD, and the space before the text goes."""
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _decoder(vocabulary, columns: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value.table
        for batch in batches:
            out = [None if x is None else decode_ids(x, table) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "decoded"])

    return run


def decode_texts(encoded: DataFrame, model_path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, decoded) of rows with ids.

    Null ids give null, no ids an empty text. Null and repeated keys stay, one row a row; an empty table gives an empty one;
    other columns are left out. No shuffle.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = pick(encoded, key, "ids")
    return rows.mapInArrow(_decoder(shared, [key]), f"`{key}` {rows.schema[key].dataType.simpleString()}, decoded string")


def _digests(vocabulary) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value.table
        for batch in batches:
            n, crc, back = [], [], []
            for text, ids in zip(batch.column("_text"), batch.column("ids"), strict=True):
                values = ids.values
                array = values.to_numpy()
                n.append(len(array))
                crc.append(zlib.crc32(array.astype("<u4").tobytes()))
                back.append(decode_ids(array.tolist(), table) == (text.as_py() or "").replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())], names=["_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def op10_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = encode_texts(docs).toDF("_id", "_text", "ids")
    shared = spark.sparkContext.broadcast(Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model")))
    kind = encoded.schema["_id"].dataType.simpleString()
    return encoded.mapInArrow(_digests(shared), f"_id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean").withColumnRenamed("_id", "doc_id")


