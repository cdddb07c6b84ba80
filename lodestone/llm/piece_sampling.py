"""SentencePiece encoding and decoding with sampling of distinct segmentations.

The lattice of a text holds every way to write it in pieces of the given model; pieces
carry log-probabilities, and a segmentation's probability is the normalised product.
Gumbel top-k: every segmentation's log-probability plus its own Gumbel noise is its
perturbed score, and the k largest are a sample without replacement. They are found by
A-star search from the top: the whole lattice has a Gumbel maximum; a set of
segmentations with a known maximum is split along its best path into the sets that leave
it at each piece, whose maxima are Gumbels cut off there; the best open set is next.
Backward sums over the lattice make every bound exact. The (k+1)-th score is the
threshold of the inclusion scores, log(1 - exp(-exp(log p - threshold))).

All noise comes from a hash of the row key, the seed and the place, so results do not
depend on partitions. Spaces are part of pieces; a space is put before each text, as
the model does; characters without a piece are written in byte pieces, so decoding
gives back every text exactly (also one that holds the model's own space mark).

Edge cases: a null or empty text has one segmentation, of no pieces; a text with fewer
than k segmentations gives all of them, with inclusion 1; null ids share one key; equal
rows give equal rows; a column that clashes with an output column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import BASE, BASE_INV, BYTE_CODE, U64, added_schema, given_back, mix, powers, slices, text_buffers, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
SEED = 29
BATCH = 1 << 18
C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
MARK = "▁"
LONGER, PREFIX = 1 << 30, -2
#: edges that a task keeps for later texts
KEPT = 5 << 19
#: bytes of a slice and edges that are kept where memory counts more than time
LEAN = (1 << 16, 5 << 17)


def salt(*parts: tuple[int, int]) -> np.uint64:
    """Sum of numbers times constants, modulo 2**64."""
    return U64(sum(int(a) * int(C[c]) for a, c in parts) % (1 << 64))


def substring_hash(total: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((total[e] - total[s]) * powers(BASE_INV, len(total))[s] + (e - s).astype(U64) * C[1])


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_CODE[buf] * powers(BASE, len(buf)), out=total[1:])
    return total


@dataclass
class Pieces:
    """Bytes and log-probability of each piece, and a hash table of those that text can match."""

    text: list[bytes]
    logp: np.ndarray
    byte_id: np.ndarray
    longest: int
    keys: np.ndarray
    ids: np.ndarray
    reach: int
    alone: np.ndarray

    @classmethod
    def of(cls, text: list[bytes], logp: np.ndarray, matched: np.ndarray, byte_id: np.ndarray) -> Pieces:
        """matched: ids of the pieces that text can match; byte_id: the piece of each byte."""
        # proper prefixes of pieces are entries too, so that a search ends where no longer piece is
        longer = {text[i].decode()[:k].encode() for i in matched for k in range(1, len(text[i].decode()))}
        entries = {text[i]: int(i) + (LONGER if text[i] in longer else 0) for i in matched}
        entries |= {x: PREFIX for x in longer if x not in entries}
        size = 1 << max(4, int(np.ceil(np.log2(4 * len(entries) + 1))))
        keys, ids, reach = np.zeros(size, U64), np.full(size, -1, np.int64), 0
        buf = np.frombuffer(b"".join(entries), np.uint8)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in entries])))
        for h, i in zip(substring_hash(prefix_sums(buf), edge[:-1], edge[1:]), entries.values()):
            at, k = int(h) % size, 0
            while ids[(at + k) % size] != -1:
                k += 1
            keys[(at + k) % size], ids[(at + k) % size], reach = h, i, max(reach, k)
        alone = np.zeros(256, bool)
        alone[:128] = True
        alone[0x20] = False
        for i in matched:
            if len(text[i].decode()) > 1:
                alone[np.frombuffer(text[i], np.uint8)] = False
        return cls(text, logp, byte_id, max(len(text[i].decode()) for i in matched), keys, ids, reach, alone)

    @classmethod
    def loaded(cls, model: bytes) -> Pieces:
        """From a model file. Merge ranks, where a model has those for scores, become Zipf log-probabilities."""
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        matched = np.array([i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])
        if (np.diff(score[matched]) == -1).all():  # ranks
            score = -np.log(2.0 - np.minimum(score, 0)) - np.log(np.log(n + 2.0))
        byte_id = np.full(256, sp.unk_id(), np.int64)
        text = [x.replace(MARK, " ").encode() for x in names]
        for i in range(n):
            if sp.is_byte(i):
                byte_id[int(names[i][3:5], 16)] = i
                text[i] = bytes([int(names[i][3:5], 16)])
                score[i] = score[matched].min() - 1
            elif sp.is_control(i) or sp.is_unknown(i):
                text[i] = b""
        return cls.of(text, score, matched, byte_id)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash (plus LONGER if it begins a longer one), PREFIX if it only begins pieces, or -1."""
        size = len(self.keys)
        at = (h % U64(size)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        miss = np.flatnonzero((self.keys[at] != h) & (self.ids[at] != -1))
        for k in range(1, self.reach + 1):
            if not len(miss):
                break
            to = (at[miss] + k) % size
            hit = self.keys[to] == h[miss]
            out[miss[hit]] = self.ids[to[hit]]
            miss = miss[~hit & (self.ids[to] != -1)]
        return out

    def __post_init__(self) -> None:
        self.kept = Kept()
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.names = np.array(self.text, object)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)

    def decoded_bytes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 of piece ids; the space put before the text goes."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1])][1:] if len(ids) else self.flat[:0]

    def same_as(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bool]:
        """Whether each stretch ids[at[i]:at[i+1]] decodes to data[start[i]:end[i]]."""
        out = []
        for a, z, p, q in zip(at.tolist(), at[1:].tolist(), start.tolist(), end.tolist()):
            out.append(b"".join(self.names[ids[a:z]].tolist())[1:] == data[p:q].tobytes())
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded_bytes(ids).tobytes().decode("utf-8", "replace")


def built(p: Pieces, own: np.ndarray, edge: np.ndarray) -> dict[str, np.ndarray]:
    """Lattices of the units own[edge[i]:edge[i+1]]: bytes, nodes and edges."""
    char = np.flatnonzero((own & 0xC0) != 0x80)
    node0 = np.searchsorted(char, edge[:-1])  # first node of each unit
    unit = np.searchsorted(edge, char, side="right") - 1
    rem = (np.searchsorted(char, edge[1:])[unit] - np.arange(len(char))).astype(np.int32)
    char = np.concatenate((char, [len(own)])).astype(np.int32)
    total, parts = prefix_sums(own), []
    s = np.arange(len(rem))
    degree = np.zeros(len(rem), np.int32)
    for length in range(1, p.longest + 1):
        s = s[rem[s] >= length]
        if not len(s):
            break
        piece = p.find(substring_hash(total, char[s], char[s + length]))
        on = piece >= 0
        if length == 1:  # a character without a piece has its bytes
            parts.append((s, np.full(len(s), 1, np.int32), degree[s], np.where(on, piece % LONGER, -1).astype(np.int32)))
            degree[s] = 1
        else:
            at = s[on]
            parts.append((at, np.full(len(at), length, np.int32), degree[at], (piece[on] % LONGER).astype(np.int32)))
            degree[at] += 1
        s = s[(piece == PREFIX) | (on & (piece >= LONGER))]  # the rest of the texts cannot go on
    node, length, nth, piece = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
    del parts
    # nodes in order of what remains after them, the edges of each by length
    by = np.argsort(rem.astype(np.uint16) if len(rem) and rem.max() < 1 << 16 else rem, kind="stable")
    edge0 = np.zeros(len(rem), np.int32)
    edge0[by] = np.cumsum(degree[by]) - degree[by]
    order = np.empty(len(node), np.int32)
    order[edge0[node] + nth] = np.arange(len(node), dtype=np.int32)
    node, length, piece = node[order].astype(np.int32), length[order].astype(np.int32), piece[order].astype(np.int32)
    del order, nth
    bytes_ = char[node + 1] - char[node] if len(node) else node
    score = np.where(piece >= 0, p.logp[np.maximum(piece, 0)], bytes_ * p.logp[p.byte_id[0]])
    n_ids = np.where(piece >= 0, 1, bytes_).astype(np.int8)
    beta = np.zeros(len(rem) + 1)
    heads = edge0[by]
    blocks = np.searchsorted(rem[by], np.arange(1, (rem.max() if len(rem) else 0) + 2))
    prob = np.zeros(len(node))
    ends = np.concatenate((heads[1:], [len(node)]))
    for a, z in zip(blocks, blocks[1:]):
        if a == z:
            continue
        lo, hi = heads[a], ends[z - 1]
        to = node[lo:hi] + length[lo:hi]
        v = score[lo:hi] + np.where(length[lo:hi] == rem[by[a]], 0.0, beta[to])
        h = heads[a:z] - lo
        top = np.maximum.reduceat(v, h)
        reps = degree[by[a:z]]
        v -= np.repeat(top, reps)
        w = np.exp(v, out=v)
        s = np.add.reduceat(w, h)
        beta[by[a:z]] = top + np.log(s)
        w /= np.repeat(s, reps)
        prob[lo:hi] = w
    c = np.cumsum(prob)
    cum = c - np.repeat(np.concatenate(([0.0], c))[heads], ends - heads)
    return {"buf": own, "char": char, "node0": node0, "rem": rem, "edge0": edge0, "degree": degree, "node": node, "length": length, "piece": piece, "n_ids": n_ids, "p": prob, "cum": cum}


class Kept:
    """Lattices of units by their hash, in arrays that grow at the end, up to ``most`` edges and those of one slice."""

    NAMES = ("buf", "char", "node0", "rem", "edge0", "degree", "node", "length", "piece", "n_ids", "p", "cum")

    def __init__(self, most: int = KEPT) -> None:
        self.most = most
        self.hashes, self.order = np.zeros(0, U64), np.zeros(0, np.int64)
        self.edges = 0
        self.room: dict[str, np.ndarray] = {}

    def find(self, units: np.ndarray) -> np.ndarray:
        """Number of each unit, or -1."""
        if not len(self.hashes):
            return np.full(len(units), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, units), len(self.hashes) - 1)
        return np.where(self.hashes[at] == units, self.order[at], -1)

    def add(self, units: np.ndarray, new: dict[str, np.ndarray]) -> np.ndarray:
        """Numbers of new units."""
        first = not self.room
        was = {} if first else {n: len(getattr(self, n)) for n in self.NAMES}
        shift = {} if first else {"char": len(self.buf), "node0": len(self.rem), "edge0": self.edges, "node": len(self.rem)}
        for n in self.NAMES:
            x = new[n] + new[n].dtype.type(shift[n]) if n in shift else new[n]
            at = was.get(n, 0) - (n == "char" and not first)  # the end mark of the last one makes way
            if first or at + len(x) > len(self.room[n]):
                room = np.empty(at + len(x) if first else (at + len(x)) * 5 // 4, x.dtype)
                if not first:
                    room[:at] = self.room[n][:at]
                self.room[n] = room
            self.room[n][at : at + len(x)] = x
            setattr(self, n, self.room[n][: at + len(x)])
        numbers = np.arange(len(units)) + was.get("node0", 0)
        at = np.searchsorted(self.hashes, units)
        self.hashes, self.order = np.insert(self.hashes, at, units), np.insert(self.order, at, numbers)
        self.edges = len(self.node)
        return numbers


class Lattice:
    """Lattices of the distinct units of some texts.

    A unit is a run of spaces with what follows up to the next space: no piece reaches
    beyond it. Nodes are characters of distinct units; edges are grouped by node. Units
    of earlier texts of the task stay, up to ``Kept.most`` edges, so that common ones are built once.
    """

    def __init__(self, pieces: Pieces, data: np.ndarray, off: np.ndarray, i: int, j: int):
        self.pieces = pieces
        n = j - i
        lens = off[i + 1 : j + 1] - off[i:j]
        at = np.concatenate(([0], np.cumsum(lens + (lens > 0))))
        buf = np.full(int(at[-1]), 0x20, np.uint8)
        src = data[off[i] : off[j]]
        owner = np.repeat(np.arange(n), lens)
        buf[np.arange(len(src)) + np.cumsum(lens > 0)[owner]] = src
        space = buf == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[at[:-1][lens > 0]] = True
        lone = pieces.alone[buf]
        cut |= lone
        cut[1:] |= lone[:-1]
        start = np.flatnonzero(cut)
        end = np.concatenate((start[1:], [len(buf)])).astype(np.int64)
        self.first = np.searchsorted(start, at)  # units of each text
        total = prefix_sums(buf)
        units, head, kind = np.unique(substring_hash(total, start, end), return_index=True, return_inverse=True)
        have = pieces.kept
        known = have.find(units)
        if have.edges > have.most:
            have = pieces.kept = Kept(have.most)
            known[:] = -1
        fresh = np.flatnonzero(known < 0)
        size = (end - start)[head[fresh]]
        edge = np.concatenate(([0], np.cumsum(size)))
        own = buf[np.repeat(start[head[fresh]] - edge[:-1], size) + np.arange(edge[-1])]
        known[fresh] = have.add(units[fresh], built(pieces, own, edge))
        self.kind = known[kind]
        for name in Kept.NAMES:
            setattr(self, name, getattr(have, name))

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path to the unit's end from each node: edges of all paths one after another, and their numbers."""
        who: np.ndarray | None = None  # all, before the first step
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.ones(len(node), np.int64)
        step = 0
        while len(node):
            u = (mix((key if who is None else key[who]) + salt((step + 1, 3))) >> U64(11)).astype(float)
            u *= 2.0**-53
            e = self.edge0[node].astype(np.int64)
            last = e + self.degree[node] - 1
            move = np.flatnonzero((u >= self.cum[e]) & (e < last))
            if len(move):
                at, u, last = e[move] + 1, u[move], last[move]
                while True:
                    on = np.flatnonzero((u >= self.cum[at]) & (at < last))
                    if len(on) < len(at):
                        e[move] = at
                    if not len(on):
                        break
                    move, at, u, last = move[on], at[on] + 1, u[on], last[on]
            taken.append((who, e))
            step_to = self.length[e]
            go = np.flatnonzero(step_to < self.rem[node])
            node = node[go] + step_to[go]
            who = go if who is None else who[go]
            count[who] += 1
            step += 1
        out = np.zeros(int(count.sum()), np.int64)
        at = np.cumsum(count) - count
        for k, (w, e) in enumerate(taken):
            out[at if w is None else at[w] + k] = e
        return out, count

    def ids(self, path: np.ndarray) -> np.ndarray:
        """Piece ids of edges."""
        piece = self.piece[path]
        bare = np.flatnonzero(piece < 0)
        if not len(bare):
            return piece
        if (self.n_ids[path[bare]] == 1).all():
            piece[bare] = self.pieces.byte_id[self.buf[self.char[self.node[path[bare]]]]]
            return piece
        n = self.n_ids[path].astype(np.int64)
        out = np.repeat(piece, n)
        bare = np.flatnonzero(out < 0)
        # a byte's place: its character's first byte, and how far the id is into the character
        into = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(self.char[self.node[path]], n)
        out[bare] = self.pieces.byte_id[self.buf[first[bare] + into[bare]]]
        return out

    def ids_of(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all paths one after another, and where each path's begin (one more entry at the end)."""
        flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        edge = np.concatenate(([0], np.cumsum(self.n_ids[flat], dtype=np.int64)))
        return self.ids(flat).astype(np.int32), edge[np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int64)]


def gumbel(key: np.ndarray) -> np.ndarray:
    u = ((mix(key) >> U64(32)).astype(float) + 0.5) * 2.0**-32
    return -np.log(-np.log(u))


def cut_off(g: np.ndarray, at: np.ndarray | float) -> np.ndarray:
    """Gumbel draws conditioned to lie below ``at``: -log(exp(-at) + exp(-g))."""
    return -np.logaddexp(-at, -g)


@dataclass
class Sample:
    """A sampled segmentation of a text: edges, log-probability before each of them and of all, perturbed score, log inclusion."""

    path: np.ndarray
    before: np.ndarray
    score: float
    inclusion: float = 0.0

    @property
    def logp(self) -> float:
        return float(self.before[-1])


def one(key: int) -> int:
    """:func:`mix` of a single number."""
    key &= (1 << 64) - 1
    key = (key ^ key >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    key = (key ^ key >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return key ^ key >> 31


class Search:
    """The open sets of one text: (-bound, path number, place in the path, edges left out there)."""

    def __init__(self, lattice: Lattice, key: int, units: np.ndarray):
        self.lattice, self.key, self.units = lattice, key, units
        self.found: list[Sample] = []
        self.open: list[tuple[float, int, int, tuple[int, ...]]] = []

    def branch(self) -> tuple[float, np.ndarray, int, int] | None:
        """Pop the best set: its bound, the fixed pieces with the new one, and the unit and node where the rest is free."""
        if not self.open:
            return None
        neg, own, t, out = heapq.heappop(self.open)
        lat, path = self.lattice, self.found[own].path
        node = int(lat.node[path[t]])
        a = int(lat.edge0[node])
        left = [e for e in range(a, a + int(lat.degree[node])) if e not in out]
        share = lat.p[left].tolist()
        k = len(self.found)
        total = sum(share)
        pick = (one(self.key + int(salt((k, 2), (1, 3)))) >> 11) * 2.0**-53 * total
        so_far = list(accumulate(share))
        e = left[min(bisect_right(so_far, pick), len(left) - 1)]
        if len(left) > 1:
            rest = max(total - float(lat.p[e]), 1e-300)
            noise = -math.log(-math.log(((one(self.key + int(salt((k, 3), (1, 1)))) >> 32) + 0.5) * 2.0**-32))
            heapq.heappush(self.open, (-float(cut_off(math.log(rest) + float(self.found[own].before[t]) + noise, -neg)), own, t, (*out, e)))
        done = path[:t]
        # units that the first t pieces pass: those whose last piece lies before place t
        passed = int((lat.length[done] == lat.rem[lat.node[done]]).sum())
        return -neg, np.append(done, e), passed, int(node + lat.length[e]) if lat.length[e] < lat.rem[node] else -1


def smallest(x: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of each stretch of x (n: their lengths), in order of stretch and value."""
    x = x.copy()
    on = np.flatnonzero(n)
    size = n[on]
    head = np.cumsum(size) - size
    found = []
    for r in range(min(k, int(size.max(initial=0)))):
        low = np.minimum.reduceat(x, head)
        at = np.flatnonzero(x == np.repeat(low, size))
        which = np.searchsorted(head, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = which[1:] != which[:-1]
        at, which = at[new], which[new]
        ok = size[which] > r
        found.append((on[which[ok]] * k + r, at[ok]))
        x[at] = np.inf
    if not found:
        return np.zeros(0, np.int64)
    key, at = (np.concatenate(v) for v in zip(*found))
    return at[np.argsort(key)]


#: places whose probability so far has fallen by this much are looked at only where the bounds ask for it
FALL = 27.0


def emit(searches: list[Search], paths: list[np.ndarray], scores: list[float], since: list[int], left: int) -> None:
    """Take a path for each search, whose first ``since`` pieces are fixed, and open the sets that leave it later.

    Only the best ``left`` + 1 of all open sets can still matter: those of the paths to come, and the threshold.
    """
    lat, keep = searches[0].lattice, left
    limit = np.array([heapq.nsmallest(keep + 1, s.open)[-1][0] if len(s.open) > keep else np.inf for s in searches])
    start, until, befores = [], [], []
    for path, a in zip(paths, since):  # sums of a text do not depend on its neighbours
        before = np.zeros(len(path) + 1)
        np.cumsum(np.log(np.maximum(lat.p[path], 1e-300)), out=before[1:])
        befores.append(before)
        start.append(float(before[min(a, len(path))]))
        until.append(int(np.searchsorted(-before[: len(path)], FALL - start[-1], side="right")))
    # no noise is over 23 and ``before`` only falls: places below cannot bring what is better than the open sets
    until = [min(z, int(np.searchsorted(-b[: len(p)], x + 23, side="right"))) if x < np.inf else z for z, b, p, x in zip(until, befores, paths, limit.tolist())]
    for s, p, score, before in zip(searches, paths, scores, befores):
        s.found.append(Sample(p, before, score))
    own = [len(s.found) - 1 for s in searches]
    base = np.array([s.key for s in searches], U64) + np.array([salt((k + 1, 1), (1, 0)) for k in own], U64)
    top, floor = np.array(scores), np.array(start) - FALL
    todo = np.arange(len(paths))
    for first in (True, False):
        cut = [(since[d], until[d] if first else len(paths[d])) for d in todo.tolist()]
        n = np.array([max(z - a, 0) for a, z in cut], np.int64)
        text = np.repeat(todo, n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n - np.array([a for a, _ in cut], np.int64), n)
        step = np.concatenate([paths[d][a:z] for d, (a, z) in zip(todo.tolist(), cut)] + [np.zeros(0, np.int64)])
        so_far = np.concatenate([befores[d][a : max(a, z)] for d, (a, z) in zip(todo.tolist(), cut)] + [np.zeros(0)])
        ok = lat.degree[lat.node[step]] > 1
        text, place, step, so_far = text[ok], place[ok], step[ok], so_far[ok]
        other = np.log(np.maximum(1 - lat.p[step], 1e-300)) + so_far
        best = -cut_off(other + gumbel(base[text] + place.astype(U64) * C[2]), top[text])
        n = np.bincount(text, minlength=len(paths))
        order = smallest(best, n, keep + 1)
        text, place, step, best = text[order], place[order], step[order], best[order]
        if first:
            worst = limit.copy()
            last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if len(text) else np.zeros(0, np.int64)
            last = last[n[text[last]] > keep]
            worst[text[last]] = np.minimum(worst[text[last]], best[last])
            # places left out for being FALL below ``since``, where what is found says too little
            todo = np.flatnonzero((worst + 23 > -floor) & np.array([z < len(p) for z, p in zip(until, paths)], bool))
            again = np.isin(text, todo)
            text, place, step, best = text[~again], place[~again], step[~again], best[~again]
        for k, t, e, b in zip(text.tolist(), place.tolist(), step.tolist(), best.tolist()):
            heapq.heappush(searches[k].open, (b, own[k], t, (e,)))
        if not len(todo):
            break


def sample_texts(pieces: Pieces, data: np.ndarray, off: np.ndarray, i: int, j: int, keys: np.ndarray, k: int) -> tuple[Lattice, list[list[Sample]]]:
    """Up to k distinct segmentations of each text, best perturbed score first."""
    lat = Lattice(pieces, data, off, i, j)
    n = j - i
    searches = [Search(lat, int(keys[d]), lat.kind[lat.first[d] : lat.first[d + 1]]) for d in range(n)]

    def tails(jobs: list[tuple[int, int, int]], number: int) -> list[np.ndarray]:
        """For (text, first free unit, node inside the unit before it or -1): a random rest."""
        nodes, key, sizes = [], [], []
        for d, u, inner in jobs:
            own = lat.node0[searches[d].units[u:]]
            if inner >= 0:
                own = np.concatenate(([inner], own))
            place = np.arange(len(searches[d].units) - len(own), len(searches[d].units))
            nodes.append(own)
            key.append(place.view(U64) * C[1] + U64(searches[d].key))
            sizes.append(len(own))
        path, count = lat.walk(np.concatenate(nodes), mix(np.concatenate(key) + salt((number + 1, 0))))
        edge = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [path[a:z] for a, z in zip(edge, edge[1:])]

    if n:
        emit(searches, tails([(d, 0, -1) for d in range(n)], 0), gumbel(keys + C[2]).tolist(), [0] * n, k - 1)
    for number in range(1, k):
        jobs, heads = [], []
        for d, s in enumerate(searches):
            got = s.branch()
            if got is not None:
                bound, fixed, unit, inner = got
                jobs.append((d, unit + 1, inner))
                heads.append((bound, fixed))
        if not jobs:
            break
        paths = [np.concatenate((fixed, rest)) for (_, fixed), rest in zip(heads, tails(jobs, number))]
        emit([searches[d] for d, _, _ in jobs], paths, [b for b, _ in heads], [len(f) for _, f in heads], k - 1 - number)
    for s in searches:
        floor = -s.open[0][0] if s.open else -np.inf
        for x in s.found:
            x.inclusion = float(np.log(-np.expm1(-np.exp(x.logp - floor)))) if x.logp - floor > -30 else x.logp - floor
            if floor == -np.inf:
                x.inclusion = 0.0
    return lat, [s.found for s in searches]


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """Hash of a row key (its text form), with the seed."""
    data, off = text_buffers(pc.cast(ids, pa.string()))
    s, e = off[:-1] - off[0], off[1:] - off[0]
    own = data[off[0] : off[-1]]
    return mix(substring_hash(prefix_sums(own), s, e) + salt((seed, 0))) if len(s) else np.zeros(0, U64)


COLUMNS = "sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, round_trip boolean"


def encoded(df: DataFrame, model: bytes, k: int = SAMPLES, seed: int = SEED, text: str = "text", key: str = "doc_id", with_ids: bool = True, keep_text: bool = True, lean: bool = False) -> DataFrame:
    """Each row up to k times: sample (from 1), figures of the segmentation, and its piece ids (array<int>) if asked for.

    lean: the same rows with less than half of the memory for lattices, in up to twice the time; a slice's memory goes back at its end.
    """
    shared = df.sparkSession.sparkContext.broadcast(Pieces.loaded(model))  # as large as the vocabulary
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["ids"] * with_ids
    gone = set() if keep_text else {text}
    slice_bytes, most = LEAN if lean else (BATCH, KEPT)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        pieces.kept = Kept(most)
        for b in batches:
            data, off = text_buffers(b.column(b.schema.get_field_index(text)))
            keys = row_keys(b.column(b.schema.get_field_index(key)), seed)
            keep = [m for m, c in enumerate(b.schema.names) if c not in names and c not in gone]
            rest = b.select([b.schema.names[m] for m in keep])
            for i, j in slices(off, slice_bytes):
                lat, found = sample_texts(pieces, data, off, i, j, keys[i:j], k)
                every = [(d, m, x) for d, own in enumerate(found) for m, x in enumerate(own)]
                ids, at = lat.ids_of([x.path for _, _, x in every])
                text_of = np.array([d for d, _, _ in every], np.int64)
                same = pieces.same_as(ids, at, data, off[i + text_of], off[i + text_of + 1])
                figures = [
                    pa.array([m + 1 for _, m, _ in every], pa.int32()), pa.array(np.diff(at)), *(pa.array(v, pa.float64()) for v in ([x.logp for _, _, x in every], [x.score for _, _, x in every], [x.inclusion for _, _, x in every])),
                    pa.array([hashlib.sha256(ids[a:z]).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist())], pa.string()), pa.array(same),
                ]
                if with_ids:
                    figures.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                t = rest.take(pa.array(i + text_of))
                yield pa.RecordBatch.from_arrays(t.columns + figures, names=t.schema.names + names)
                del lat, found, every, ids, figures, t
                if lean:
                    given_back()
        pieces.kept = Kept()

    return df.mapInArrow(tidied(kernel), added_schema(df.drop(*gone), COLUMNS + ", ids array<int>" * with_ids))


def decoded(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Add decoded string: the text of a column of piece ids (null: null)."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces.loaded(model))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(b.schema.get_field_index(ids)).to_pylist()
            keep = [m for m, c in enumerate(b.schema.names) if c != "decoded"]
            text = pa.array([None if v is None else shared.value.decode(np.array(v, np.int64)) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(m) for m in keep] + [text], names=[b.schema.names[m] for m in keep] + ["decoded"])

    return df.mapInArrow(kernel, added_schema(df, "decoded string"))


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, model_bytes(), with_ids=False, keep_text=False)
