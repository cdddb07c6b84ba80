"""Quality classifier: a second-order factorisation machine.

Inputs of a text: its hashed words (log counts, scaled to length 1), statistics of
its structure, and metadata (its length). The pairwise part is scored in linear
time: sum over factors of ((sum v x)^2 - sum v^2 x^2) / 2.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``); every row is
scored. Edge cases: null and empty texts have no words and zero statistics and get
the score of that input; without any labels every score is 0.5; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Words, added, added_schema, crc_mod, slices, text_buffers
from lodestone.llm.labelled import training_sample

BUCKETS = 1 << 15
FACTORS = 8
SAMPLE = 6000
FOLD, HELD = 3, 1
STATS = 16


def _classes() -> np.ndarray:
    """For each byte: its bit in each character class."""
    out = np.zeros((8, 256), np.int32)
    out[0, 65:91] = 1  # upper case
    out[1, 97:123] = 1  # lower case
    out[2, 48:58] = 1  # digits
    out[3, 0x20] = 1
    out[4, 0x0A] = 1
    out[5, 33:48] = out[5, 58:65] = out[5, 91:97] = out[5, 123:127] = 1  # punctuation
    out[6, np.frombuffer(b"#$%&*|!<>{}^~", np.uint8)] = 1  # marks rare in prose
    out[7, 0xC0:] = 1  # first bytes of longer characters
    return out


CLASSES = _classes()


@dataclass
class Rows:
    """Sparse rows: words idx/val with ptr (n+1), and dense statistics."""

    idx: np.ndarray
    val: np.ndarray
    ptr: np.ndarray
    stats: np.ndarray


def features(data: np.ndarray, off: np.ndarray, i: int, j: int) -> Rows:
    """Inputs of texts i..j of a buffer."""
    n = j - i
    w = Words(data, off, i, j)
    h = w.hash
    doc = w.doc
    key, count = np.unique(doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    owner = key // BUCKETS
    ptr = np.searchsorted(owner, np.arange(n + 1))
    val = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, val * val, minlength=n))
    val = (val / np.maximum(norm, 1e-9)[owner]).astype(np.float32)
    src = data[off[i] : off[j]]
    hist = np.zeros((n, 256), np.int64)
    bounds = off[i : j + 1] - off[i]
    for r in range(n):
        hist[r] = np.bincount(src[bounds[r] : bounds[r + 1]], minlength=256)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    by = hist @ CLASSES.T
    words = np.diff(w.first).astype(float)
    one = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    distinct = np.diff(ptr)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    same = np.zeros(n)
    if len(h) > 1:
        np.add.at(same, doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], 1)
    mean_len = np.bincount(doc, length, minlength=n) / one
    sq = np.bincount(doc, length * length, minlength=n) / one
    stats = np.column_stack(
        [
            *(by[:, k] / size for k in range(8)),
            by[:, 0] / np.maximum(by[:, 0] + by[:, 1], 1),
            mean_len,
            np.sqrt(np.maximum(sq - mean_len**2, 0)),
            distinct / one,
            top / one,
            same / one,
            np.log1p(words / (by[:, 4] + 1.0)),
            np.log1p(by[:, 1] + by[:, 0] + 0.0),
        ]
    )
    return Rows(key % BUCKETS, val, ptr, stats)


def joined(parts: list[Rows]) -> Rows:
    at = np.cumsum([0] + [len(p.idx) for p in parts])
    ptr = np.concatenate([[0]] + [p.ptr[1:] + a for p, a in zip(parts, at)])
    return Rows(np.concatenate([p.idx for p in parts]), np.concatenate([p.val for p in parts]), ptr, np.concatenate([p.stats for p in parts]))


@dataclass
class FactorisationMachine:
    """score = sigmoid(w0 + w.x + pairwise part); columns 0..STATS-1 of the dense part come after the words."""

    w0: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + STATS))
    v: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + STATS, FACTORS)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(STATS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(STATS))

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / 2

    def margin(self, r: Rows) -> np.ndarray:
        n = len(r.ptr) - 1
        x = self.dense(r.stats)
        own = np.repeat(np.arange(n), np.diff(r.ptr))
        linear = np.bincount(own, r.val * self.w[r.idx], minlength=n) + x @ self.w[BUCKETS:]
        pair = np.zeros(n)
        for f in range(self.v.shape[1]):
            vx = r.val * self.v[r.idx, f]
            s = np.bincount(own, vx, minlength=n) + x @ self.v[BUCKETS:, f]
            q = np.bincount(own, vx * vx, minlength=n) + (x * x) @ (self.v[BUCKETS:, f] ** 2)
            pair += (s * s - q) / 2
        return self.w0 + linear + pair

    def score(self, r: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(r), -35, 35)))

    @classmethod
    def fitted(cls, r: Rows, y: np.ndarray, epochs: int = 12, rate: float = 0.1, batch: int = 64, penalty: float = 2e-4, seed: int = 3) -> FactorisationMachine:
        """Adagrad over mini-batches; rows must come in an order that does not depend on the run."""
        n = len(y)
        m = cls()
        if not n or y.min() == y.max():
            m.w0 = 0.0 if not n else (4.0 if y[0] else -4.0)
            return m
        rng = np.random.default_rng(seed)
        m.mean, m.scale = r.stats.mean(axis=0), np.maximum(r.stats.std(axis=0), 1e-6)
        m.v = rng.normal(0, 0.02, m.v.shape)
        m.w0 = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        gw, gv, g0 = np.full(m.w.shape, 1e-2), np.full(m.v.shape, 1e-2), 1e-2
        tail = np.arange(BUCKETS, BUCKETS + STATS)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
                lens = r.ptr[rows + 1] - r.ptr[rows]
                at = np.repeat(r.ptr[rows] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
                x = m.dense(r.stats[rows])
                idx = np.concatenate([r.idx[at], np.tile(tail, len(rows))])
                val = np.concatenate([r.val[at], x.ravel()]).astype(float)
                own = np.concatenate([np.repeat(np.arange(len(rows)), lens), np.repeat(np.arange(len(rows)), STATS)])
                uniq, inv = np.unique(idx, return_inverse=True)
                w, v = m.w[uniq], m.v[uniq]
                vx = val[:, None] * v[inv]
                s = np.column_stack([np.bincount(own, vx[:, f], minlength=len(rows)) for f in range(FACTORS)])
                q = np.bincount(own, (vx * vx).sum(axis=1), minlength=len(rows))
                z = m.w0 + np.bincount(own, val * w[inv], minlength=len(rows)) + ((s * s).sum(axis=1) - q) / 2
                err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]) / len(rows)
                g = val * err[own]
                dw = np.bincount(inv, g, minlength=len(uniq)) + penalty * w
                step = g[:, None] * (s[own] - vx)
                dv = np.column_stack([np.bincount(inv, step[:, f], minlength=len(uniq)) for f in range(FACTORS)]) + penalty * v
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                g0 += err.sum() ** 2
                m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                m.v[uniq] -= rate * dv / np.sqrt(gv[uniq])
                m.w0 -= rate * err.sum() / np.sqrt(g0)
        return m


def fit(sample: DataFrame) -> FactorisationMachine:
    """Fit on doc_id, text, y; the sample must be bounded, as its inputs (not texts) go to the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(1))
            for i, j in slices(off):
                r = features(data, off, i, j)
                rows = [(r.idx[a:z].astype(np.int32), r.val[a:z], r.stats[k]) for k, (a, z) in enumerate(zip(r.ptr, r.ptr[1:]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *(pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in range(3))], names=["doc_id", "y", "idx", "val", "stats"])

    got = sample.select("doc_id", "text", "y").mapInArrow(kernel, "doc_id bigint, y int, idx binary, val binary, stats binary").toArrow()
    order = np.lexsort((np.array([len(x.as_buffer()) for x in got["idx"]], np.int64), got["doc_id"].to_numpy())) if got.num_rows else np.zeros(0, np.int64)
    if not len(order):
        return FactorisationMachine()
    parts = []
    idx, val, stats = got["idx"].to_pylist(), got["val"].to_pylist(), got["stats"].to_pylist()
    for k in order:
        a = np.frombuffer(idx[k], np.int32).astype(np.int64)
        parts.append(Rows(a, np.frombuffer(val[k], np.float32), np.array([0, len(a)]), np.frombuffer(stats[k], np.float64)[None]))
    return FactorisationMachine.fitted(joined(parts), got["y"].to_numpy()[order].astype(float))


def scored(docs: DataFrame, model: FactorisationMachine, text: str = "text") -> DataFrame:
    """Add score double and predicted int."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + STATS) x (FACTORS + 1) numbers

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(b.schema.get_field_index(text)))
            out = [shared.value.score(features(data, off, i, j)) for i, j in slices(off)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield added(b, {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.mapInArrow(kernel, added_schema(docs, "score double, predicted int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(training_sample(docs, labels, "quality", FOLD, HELD, SAMPLE))
    out = scored(docs, model).withColumn("held_out", crc_mod("doc_id", FOLD) == HELD)
    return out.select("doc_id", "held_out", "score", F.col("predicted"))
