"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are runs of letters, A-Z lowered. A token's probability of standing in a toxic
text comes from document counts under a chain of Dirichlet priors: the share of all
texts, then prefixes of 4, 5 and 6 bytes, then the whole token, each level the prior
of the next; so an unseen inflection takes after its stem. Counts live in a hashed
table of fixed size. A token's score is its log-odds against an even chance, so that
most tokens count against a segment. A linear scan finds all maximal segments
(Ruzzo and Tompa); the best one is calibrated by the extreme-value law of maximal
scores (expected number of chance segments E = K n exp(-lambda s)), the number of
significant ones is added, and a logistic curve turns both into a score.

Edge cases: a null, empty or letterless text has no segment and the score of none;
without labels of both kinds every score is 0 with the prior as it is; rows are
scored one by one, so repeated rows and extra columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import U64, Words, added, added_schema, crc_mod, mix, slices, text_buffers, tidied
from lodestone.llm.labelled import training_sample

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
SAMPLE = 40000
FOLD, HELD = 5, 0
#: pseudo-documents that each level's prior stands for
STRENGTH = 4.0
LOW, HIGH = -2.0, 6.0

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def tokens(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[Words, np.ndarray]:
    """Tokens of texts i..j and, for each, its bucket at each level; -1 where a token is no longer than the prefix."""
    w = Words(data, off, i, j, NOT_LETTER)
    out = np.full((len(PREFIXES) + 1, len(w.start)), -1, np.int64)
    size = w.end - w.start
    for k, p in enumerate(PREFIXES):
        long = size > p
        out[k, long] = (mix(w.hash_of(w.start[long], w.start[long] + p) + U64(k + 1)) % U64(BUCKETS)).astype(np.int64)
    out[-1] = (w.hash % U64(BUCKETS)).astype(np.int64)
    return w, out


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of a sequence, in order of place.

    Linear in the sequence; the list is walked through the positive scores only.
    """
    total = np.concatenate(([0.0], np.cumsum(score)))
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    back: list[int] = []  # for each kept segment: the nearest earlier one with a smaller left total
    for i in np.flatnonzero(score > 0):
        lo, hi, a, b = total[i], total[i + 1], int(i), int(i) + 1
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            lo, a = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
        left.append(lo)
        right.append(hi)
        span.append((a, b))
        back.append(j)
    return [(r - lo, a, b) for lo, r, (a, b) in zip(left, right, span)]


@dataclass
class ToxicityModel:
    """Document counts by bucket (toxic, clean), and the calibration."""

    toxic: np.ndarray
    clean: np.ndarray
    share: float
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-1.0, 1.0, 1.0)

    def token_scores(self, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of tokens; own: the label of each token's text where that text's count is to be left out."""
        p = np.full(at.shape[1], self.share)
        for k in range(at.shape[0]):
            on = at[k] >= 0
            b = at[k, on]
            t, c = self.toxic[b].astype(float), self.clean[b].astype(float)
            if own is not None:
                t, c = np.maximum(t - own[on], 0), np.maximum(c - (1 - own[on]), 0)
            p[on] = (t + STRENGTH * p[on]) / (t + c + STRENGTH)
        return np.clip(np.log(p / (1 - p)), LOW, HIGH)

    def evidence(self, score: np.ndarray) -> tuple[float, int, list[tuple[float, int, int]]]:
        """-ln E of the best segment, the number of those with E < 0.01, and all segments."""
        found = segments(score)
        if not found:
            return -5.0, 0, found
        base = self.log_k + np.log(len(score))
        logs = [self.lam * s - base for s, _, _ in found]
        return float(np.clip(max(logs), -5, 40)), sum(x > 4.6 for x in logs), found

    def score(self, best: np.ndarray, many: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(many), -35, 35)))


def counted(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of each kind by bucket; at most BUCKETS rows reach the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS + 1), np.int32)
        for b in batches:
            data, off = text_buffers(b.column(0))
            y = b.column(1).to_numpy()
            for i, j in slices(off):
                w, at = tokens(data, off, i, j)
                doc = w.doc
                for k in range(at.shape[0]):
                    on = at[k] >= 0
                    key = np.unique(doc[on] * BUCKETS + at[k, on])
                    for label in (0, 1):
                        sums[label, :-1] += np.bincount(key[y[i + key // BUCKETS] == label] % BUCKETS, minlength=BUCKETS).astype(np.int32)
                for label in (0, 1):
                    sums[label, -1] += int((y[i:j] == label).sum())
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[1, at].astype(np.int64)), pa.array(sums[0, at].astype(np.int64))], names=["b", "toxic", "clean"])

    got = sample.select("text", "y").mapInArrow(tidied(kernel), "b bigint, toxic bigint, clean bigint").groupBy("b").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    at = got["b"].to_numpy()
    out[1, at], out[0, at] = got["toxic"].to_numpy(), got["clean"].to_numpy()
    return out[1, :-1].astype(np.int32), out[0, :-1].astype(np.int32), int(out[1, -1]), int(out[0, -1])


def fit(sample: DataFrame) -> ToxicityModel:
    """Fit on text, y; the sample must be bounded, as a few numbers a text go to the driver."""
    toxic, clean, n1, n0 = counted(sample)
    model = ToxicityModel(toxic, clean, (n1 + 0.5) / (n1 + n0 + 1))
    if not n1 or not n0:
        model.curve = (float(np.log(model.share / (1 - model.share))), 0.0, 0.0) if n1 + n0 else (-35.0, 0.0, 0.0)
        return model
    shared = sample.sparkSession.sparkContext.broadcast(model)
    bins = 161

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(0))
            y = b.column(1).to_numpy()
            for i, j in slices(off):
                w, at = tokens(data, off, i, j)
                s = shared.value.token_scores(at, y[i:j][w.doc].astype(float))
                hist = np.bincount(np.round((s[y[i:j][w.doc] == 0] - LOW) / (HIGH - LOW) * (bins - 1)).astype(int), minlength=bins)
                best = [segments(s[a:z]) for a, z in zip(w.first, w.first[1:])]
                sure = fitted.value if fitted else None
                rows = []
                for f, a, z in zip(best, w.first, w.first[1:]):
                    base = sure[1] + np.log(max(int(z - a), 1)) if sure else 0.0
                    rows.append((max((x[0] for x in f), default=0.0), int(z - a), sum(sure[0] * x[0] - base > 4.6 for x in f) if sure else 0))
                yield pa.RecordBatch.from_arrays([pa.array(y[i:j].astype(np.int32)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hist.tolist()] + [None] * (j - i - 1), pa.list_(pa.int64()))], names=["y", "s", "n", "many", "hist"])

    fitted = None
    kinds = "y int, s double, n bigint, many bigint, hist array<bigint>"
    got = sample.select("text", "y").mapInArrow(tidied(kernel), kinds).toArrow()
    y, s, n = got["y"].to_numpy().astype(float), got["s"].to_numpy(), got["n"].to_numpy()
    hist = np.sum([h for h in got["hist"].to_pylist() if h], axis=0) + 1e-9
    values = LOW + np.arange(bins) * (HIGH - LOW) / (bins - 1)
    p = hist / hist.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):  # lambda solves sum p exp(lambda s) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    model.lam = max(low, 0.05)
    quiet = (y == 0) & (n > 0) & (s > 0)
    # the mean of lambda s - ln n of chance maxima is ln K + Euler's constant
    model.log_k = float((model.lam * s[quiet] - np.log(n[quiet])).mean() - 0.5772156649) if quiet.sum() >= 20 else -1.0
    # the second look counts significant segments where they are, so that a few numbers a text go to the driver
    fitted = sample.sparkSession.sparkContext.broadcast((model.lam, model.log_k))
    got = sample.select("text", "y").mapInArrow(tidied(kernel), kinds).drop("hist").toArrow()
    y, s, n, many = got["y"].to_numpy().astype(float), got["s"].to_numpy(), got["n"].to_numpy(), got["many"].to_numpy().astype(float)
    base = model.log_k + np.log(np.maximum(n, 1))
    best = np.where(s > 0, np.clip(model.lam * s - base, -5, 40), -5.0)
    x = np.column_stack([np.ones(len(y)), best, np.log1p(many)])
    order = np.lexsort((n, many, best, y))  # sums in one order
    x, y = x[order], y[order]
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta += np.clip(np.linalg.solve(h, x.T @ (y - q) - 1e-2 * beta), -2, 2)
    model.curve = tuple(float(b) for b in beta)
    return model


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add score double, predicted int, n_passages long and passages (word ranges of significant segments)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of BUCKETS counts

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            data, off = text_buffers(b.column(b.schema.get_field_index(text)))
            best, many, spans = [], [], []
            for i, j in slices(off):
                w, at = tokens(data, off, i, j)
                s = m.token_scores(at)
                for a, z in zip(w.first, w.first[1:]):
                    x, k, found = m.evidence(s[a:z])
                    best.append(x)
                    many.append(k)
                    floor = (m.log_k + np.log(max(z - a, 1)) + 4.6) / m.lam
                    spans.append(",".join(f"{p}:{q}" for v, p, q in found if v > floor))
            p = m.score(np.array(best, float), np.array(many, float))
            yield added(b, {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32)), "n_passages": pa.array(many, pa.int64()), "passages": pa.array(spans, pa.string())})

    return docs.mapInArrow(tidied(kernel), added_schema(docs, "score double, predicted int, n_passages bigint, passages string"))


def fitted_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit(training_sample(docs, labels, "toxic", FOLD, HELD, SAMPLE))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model).withColumn("held_out", crc_mod("doc_id", FOLD) == HELD)
    return out.select("doc_id", "held_out", "score", "predicted", "n_passages", "passages")
