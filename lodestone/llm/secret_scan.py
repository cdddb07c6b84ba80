"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over characters are trained from labelled samples,
one from random strings (keys, digests), one from ordinary identifiers and long words. A run of
token characters (16 or more, the least length trained) is reported when the ratio
of its likelihoods, as a whole and per character, is high enough; no other rule
picks runs. Pattern matches always stay; what they leave of a run on either side is
scored as a run of its own.

Edge cases: a null or empty text has no spans; repeated rows are scanned row by
row; texts are scanned whole, of any length; extra columns pass through, and one
with the name of an output column is replaced. Offsets are code points, ends are
exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import SLICE_BYTES, added, added_schema, slices, text_buffers, tidied

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")

HEX = np.zeros(256, bool)
HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
TOKEN = np.zeros(256, bool)
TOKEN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True
JOIN = np.zeros(256, bool)
JOIN[np.frombuffer(b"+/_=-", np.uint8)] = True

# Stems from which ordinary identifiers are put together.
STEMS = (
    "user name account order item value index count total list table data file path cache buffer request response "
    "handler manager factory service client server config option default version update create delete select insert "
    "session token key hash message event queue worker thread process memory page block node tree graph edge image "
    "model train test build release branch commit merge report summary daily weekly region customer supplier part"
).split()

# Words of four languages, alone or run together, as long words of prose are.
PROSE = (
    "und der ein eine nicht werden haben ueber unter zwischen gesellschaft freiheit schwierigkeit wissenschaft entwicklung regierung verwaltung "
    "versicherung bedeutung zeitung schule arbeit geschichte sicherheit krankheit wirtschaft pflicht pfad kopf empfang platz gesetz besitz "
    "schreiben sprechen lehrer gegeben berg einheit vereinlich schlicht gleichheit technisch menschlich achtung erfahrung sachlich beitrag "
    "gouvernement developpement information politique entreprise recherche environnement connaissance "
    "desarrollo gobierno informacion sociedad trabajo conocimiento empresa responsabilidad "
    "responsibility understanding international notwithstanding characteristics straightforward strength thought through"
).split()


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones, 0 for ordinary identifiers and words. A rule and a seed make them."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789"]
    out = []
    for _ in range(n):
        a = alphabets[rng.integers(len(alphabets))]
        out.append(("".join(a[k] for k in rng.integers(len(a), size=rng.integers(16, 64))), 1))
        words = [STEMS[k] for k in rng.integers(len(STEMS), size=rng.integers(2, 7))]
        style = rng.integers(5)
        if rng.random() < 0.5:
            words.insert(int(rng.integers(1, len(words) + 1)), str(rng.choice([rng.integers(10), rng.integers(100), rng.integers(1990, 2035)])))
        if rng.random() < 0.4:
            long = "".join(PROSE[k] for k in rng.integers(len(PROSE), size=rng.integers(1, 4)))
            out.append((long.capitalize() if rng.random() < 0.5 else long, 0))
        out.append((["_".join(words), "-".join(words), "".join(w.title() for w in words), "_".join(words).upper(), "/".join(words)][style], 0))
    return out


@dataclass
class MarkovPair:
    """Log-ratio tables of two character chains: ``first`` for a string's first character, ``step`` for each next."""

    first: np.ndarray
    step: np.ndarray
    least_total: float = 12.0
    least_mean: float = 0.35
    least_len: int = 16

    @classmethod
    def trained(cls, samples: list[tuple[str, int]], pseudo: float = 0.5, **limits: float) -> MarkovPair:
        first = np.full((2, 256), pseudo)
        step = np.full((2, 256, 256), pseudo)
        for s, y in samples:
            b = np.frombuffer(s.encode(), np.uint8)
            if len(b):
                first[y, b[0]] += 1
                np.add.at(step[y], (b[:-1], b[1:]), 1)
        inner = np.flatnonzero(TOKEN)
        norm = step / step[:, :, inner].sum(axis=2, keepdims=True)
        head = first / first[:, inner].sum(axis=1, keepdims=True)
        return cls(np.log(head[1] / head[0]), np.log(norm[1] / norm[0]), **limits)

    def ratio(self, s: bytes) -> float:
        b = np.frombuffer(s, np.uint8)
        return float(self.first[b[0]] + self.step[b[:-1], b[1:]].sum()) if len(b) else 0.0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.concatenate(([0] if mask[0] else [], edge, [len(mask)] if mask[-1] else [])).astype(np.int64)
    return edge[0::2], edge[1::2]


def joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for p, q in sorted(spans):
        if starts and p <= ends[-1]:
            ends[-1] = max(ends[-1], q)
        else:
            starts.append(p)
            ends.append(q)
    return starts, ends


def left_over(buf: np.ndarray, a: int, b: int, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What of the run buf[a:b] nothing covers, without the joining marks where it was cut; only what overlaps the run is looked at."""
    at, cut = a, False
    near = range(bisect_right(ends, a), bisect_left(starts, b))
    for p, q in [*((starts[k], ends[k]) for k in near), (b, b)]:
        x, y = at, min(p, b)
        while cut and x < y and JOIN[buf[x]]:
            x += 1
        while p < b and x < y and JOIN[buf[y - 1]]:
            y -= 1
        if x < y:
            yield x, y
        at, cut = max(at, q), True


def scan_slice(buf: np.ndarray, off: np.ndarray, model: MarkovPair) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) in bytes from each text's start; texts are buf[off[i]:off[i+1]]."""
    n = len(off) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def by_text(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of a class of at least so many bytes that end where a text ends, and their texts."""
        s, e = runs(mask)
        long = e - s >= least
        s, e = s[long], e[long]
        parts = []
        first, last = np.searchsorted(off, s, side="right"), np.searchsorted(off, e, side="left")
        for a, b, x, y in zip(s, e, first, last):
            for m in (*off[x:y], b):  # a run ends where a text does
                if m - a >= least:
                    parts.append((a, m))
                a = m
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z
        p = np.array(parts, np.int64)
        return p[:, 0], p[:, 1], np.searchsorted(off, p[:, 0], side="right") - 1

    for s, e, i in zip(*by_text(HEX[buf], 24)):
        found[i].append((int(s - off[i]), 2, int(e - off[i])))
    # texts that hold ':' or '=' may hold assignments
    marks = np.flatnonzero((buf == 0x3D) | (buf == 0x3A))
    raw = buf.tobytes()
    for i in np.unique(np.searchsorted(off, marks, side="right") - 1):
        for m in ASSIGN.finditer(raw[off[i] : off[i + 1]]):
            if m.end(2) - m.start(2) >= 6:
                found[i].append((m.start(), 0, m.end()))
    at = raw.find(b"AKIA")
    seen = -1
    while at >= 0:
        i = int(np.searchsorted(off, at, side="right") - 1)
        if i != seen:
            for m in ACCESS.finditer(raw[off[i] : off[i + 1]]):
                if m.end() - m.start() >= 20:
                    found[i].append((m.start(), 1, m.end()))
            seen = i
        at = raw.find(b"AKIA", at + 4)
    of, covered = -1, ([], [])
    for a, b, i in zip(*(v.tolist() for v in by_text(TOKEN[buf], model.least_len))):
        if i != of:  # runs come in order; a text's spans are joined once
            of, covered = i, joined([(int(off[i]) + p, int(off[i]) + q) for p, k, q in found[i] if k < 3])
        for x, y in left_over(buf, a, b, *covered):
            run = buf[x:y]
            total = model.first[run[0]] + model.step[run[:-1], run[1:]].sum()
            if y - x >= model.least_len and total >= max(model.least_total, model.least_mean * (y - x)):
                found[i].append((int(x - off[i]), 3, int(y - off[i])))
    return [sorted(x) for x in found]


def scanned(batch: pa.RecordBatch, text: str, model: MarkovPair) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """For each row of the batch: row, UTF-8 text, and spans in bytes."""
    data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    for i, j in slices(off, SLICE_BYTES):
        buf = data[off[i] : off[j]]
        for k, spans in enumerate(scan_slice(buf, off[i : j + 1] - off[i], model)):
            yield i + k, data[off[i + k] : off[i + k + 1]].tobytes() if spans else b"", spans


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[s]), k, int(lead[e])) for s, k, e in spans]


def scan(df: DataFrame, text: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, n_markov long, base_sha256, spans string."""
    model = model or MarkovPair.trained(labelled_samples())
    shared = df.sparkSession.sparkContext.broadcast(model)  # two tables of 256 x 256 at most

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((4, n), np.int64)
            base, every = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for row, raw, spans in scanned(batch, text, shared.value):
                if spans:
                    said = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in in_code_points(raw, spans)]
                    for k, _ in said:
                        counts[k, row] += 1
                    base[row] = hashlib.sha256(",".join(x for k, x in said if k < 3).encode()).hexdigest()
                    every[row] = ",".join(x for _, x in said)
            yield added(batch, {f"n_{KINDS[k]}": pa.array(counts[k]) for k in range(4)} | {"base_sha256": pa.array(base), "spans": pa.array(every)})

    return df.mapInArrow(tidied(kernel), added_schema(df, "n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string"))


def masked(df: DataFrame, text: str = "text", mark: str = "[SECRET]", model: MarkovPair | None = None) -> DataFrame:
    """The rows with every found span (overlapping ones joined) replaced by ``mark``; other texts as they are."""
    model = model or MarkovPair.trained(labelled_samples())
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for row, raw, spans in scanned(batch, text, shared.value):
                if spans:
                    out, last = [], 0
                    for s, _, e in spans:
                        if s >= last:
                            out += [raw[last:s], mark.encode()]
                        last = max(last, e)
                    changed[row] = b"".join([*out, raw[last:]]).decode()
            if changed:
                at = batch.schema.get_field_index(text)
                values = batch.column(at).to_pylist()
                for row, value in changed.items():
                    values[row] = value
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return df.mapInArrow(tidied(kernel), df.schema)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")
