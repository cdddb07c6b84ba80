"""Language-model scoring with Katz backoff.

Bigram and unigram counts of the training texts are discounted by Good-Turing (counts
up to ``TOP``); what a history gives up is spread over the words not seen after it,
in proportion to their unigram probability: P(v|u) = d c(u,v)/c(u) if seen, else
alpha(u) P(v), with alpha(u) = (1 - sum of seen P(.|u)) / (1 - sum of P(v) over seen v),
both sums exact. Words never seen in training share one class with the mass that
unigrams give up. Every text is words and an end; the history of the first token is
the end of a text.

Distribution: texts are packed once into chunks (word hashes and token numbers, in the
shared folder). Counts live in tables partitioned by hash ranges. Every chunk asks each
partition once for each of its distinct words and bigrams, so a common word is one
entry a chunk wherever it is; partitions add up, answer, and say which chunk accounts
for a bigram in the sums that normalise alpha. Nothing that grows is broadcast.

Edge cases: a null or empty text is the end token alone; null ids count as the empty
text for the fold; repeated rows count as often as they occur; extra columns are
ignored; an empty table gives no rows; without training texts N = V = 0, base is
log10 1 = 0 a token and the model knows the unknown class only. Counts of counts are
smoothed before they are used (a log-linear fit over their gaps), so Good-Turing gives
every count up to ``TOP`` a discount, however thin or uneven the counts of counts are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blobs import pack, pack_sorted, unpack, unpack_sorted
from lodestone.llm.common import U64, Words, crc_mod, given_back, mix, n_ranges, released, slices, text_buffers, tidied, written

CHUNK_BYTES = 24 << 20
STEP = 1 << 19
TOP = 5
#: counts of counts are gathered up to this count
RANKS = 64
#: input bytes a hash range of the count tables
RANGE_BYTES = 8 << 20
FOLD, HELD = 7, 2
END = U64(0xE5D0_0F7E_0FD0_C5A1)
ROW = "chunk bigint, kind int, bucket int, blob binary"
WORD, PAIR, HISTORY, TEXTS, STATS = range(5)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Hash range of each key; ascending with the key."""
    return ((key >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def slope(n: np.ndarray) -> float:
    """Slope of log Z_r over log r by least squares; n[r]: how many things were seen r times.

    Z_r spreads n[r] over the gap between its neighbours that occur. With one point the
    slope is -2 (Zipf's law); one that is not below -1 gives counts no discount, and is moved there.
    """
    r = np.flatnonzero(n[1:]) + 1
    if len(r) < 2:
        return -2.0
    before = np.concatenate(([0], r[:-1]))
    after = np.concatenate((r[1:], [2 * r[-1] - before[-1]]))
    x, y = np.log(r), np.log(2.0 * n[r] / (after - before))
    return float(min(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum(), -1.05))


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor for counts 0..TOP+1 (index by min(c, TOP+1)): Good-Turing's r*/r with smoothed counts of counts, moved so that it ends at TOP."""
    e = slope(n) + 1
    r = np.arange(1, TOP + 1)
    common = (TOP + 1.0) ** e  # (TOP + 1) Z[TOP + 1] / Z[1]
    return np.concatenate(([0.0], ((1 + 1 / r) ** e - common) / (1 - common), [1.0]))


class Model:
    """Unigram side of the model, from global figures."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, tokens: int, types: int):
        self.n, self.v = tokens, types
        self.d1, self.d2 = discounts(words), discounts(pairs)
        r = np.arange(1, TOP + 1)
        spare = float((words[r] * r * (1 - self.d1[r])).sum()) / tokens if tokens else 1.0
        # without rare words nothing is given up: one more token makes room
        self.scale, self.unknown = (1.0, spare) if spare > 0 else (tokens / (tokens + 1), 1 / (tokens + 1))

    def p1(self, c: np.ndarray) -> np.ndarray:
        seen = self.scale * self.d1[np.minimum(c, TOP + 1)] * c / max(self.n, 1)
        return np.where(c > 0, seen, self.unknown)

    def discounted(self, c: np.ndarray) -> np.ndarray:
        return self.d2[np.minimum(c, TOP + 1)] * c


class Chunk:
    """Texts of a chunk: vocabulary (ascending hashes), token numbers, and per text its length and fold."""

    def __init__(self, blob: bytes):
        x = pickle.loads(blob)
        self.vocab, self.tokens = unpack_sorted(x["vocab"]), unpack(x["tokens"]).view(np.int32)
        self.size, self.held, self.ids = unpack(x["size"]).astype(np.int64), unpack(x["held"]).astype(bool), x["ids"]
        self.text = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        last = np.cumsum(self.size) - 1
        self.before = np.concatenate((self.tokens[:1], self.tokens[:-1]))
        self.before[np.concatenate(([0], last[:-1] + 1))] = self.tokens[last]  # every text ends with the end token

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigram keys in ascending order, a place where each occurs, and each token's bigram."""
        key = self.vocab[self.before]
        key *= U64(0x9FB21C651E98DF25)
        key += mix(self.vocab)[self.tokens]
        key = mix(key)
        order = np.argsort(key)  # np.unique would hold several more arrays of this length
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        inv = np.empty(len(key), np.int32)
        inv[order] = np.cumsum(new, dtype=np.int32) - 1
        at = order[new].astype(np.int32)
        return key[new], at, inv


def pack_chunk(ids: list, held: list[np.ndarray], hashes: list[np.ndarray], sizes: list[np.ndarray]) -> bytes:
    vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
    return pickle.dumps({"ids": ids, "held": pack(np.concatenate(held).astype(np.uint8)), "size": pack(np.concatenate(sizes).astype(np.uint32)), "vocab": pack_sorted(vocab), "tokens": pack(tokens.astype(np.uint32))})


def rows(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["chunk", "kind", "bucket", "blob"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, held -> chunks."""
    first, made = TaskContext.get().partitionId() << 24, 0
    ids, held, hashes, sizes, size = [], [], [], [], 0
    for b in batches:
        data, off = text_buffers(b.column(1))
        h = b.column(2).to_numpy(zero_copy_only=False)
        for i, j in slices(off):
            w = Words(data, off, i, j)
            n = np.diff(w.first)
            every = np.full(len(w.start) + w.n, END, U64)
            every[np.arange(len(w.start)) + w.doc] = w.hash
            ids += b.column(0).slice(i, j - i).to_pylist()
            held.append(h[i:j])
            hashes.append(every)
            sizes.append(n + 1)
            size += int(off[j] - off[i])
            if size >= CHUNK_BYTES:
                yield rows([(first + made, TEXTS, 0, pack_chunk(ids, held, hashes, sizes))])
                ids, held, hashes, sizes, size, made = [], [], [], [], 0, made + 1
    if ids:
        yield rows([(first + made, TEXTS, 0, pack_chunk(ids, held, hashes, sizes))])


def asked(chunk: int, kind: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """A chunk's question to each hash range: its keys there, with values to add up."""
    edge = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        cut = slice(edge[b], edge[b + 1])
        yield chunk, kind, int(b), pickle.dumps((pack_sorted(keys[cut]), [pack(v[cut]) for v in values]))


def gathered(pdf: pd.DataFrame) -> tuple[list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    """Chunks in order, where each one's part ends, sums per key, and each entry's key."""
    pdf = pdf.sort_values("chunk")
    parts = [pickle.loads(b) for b in pdf["blob"]]
    keys = [unpack_sorted(k) for k, _ in parts]
    edge = np.cumsum([0] + [len(k) for k in keys])
    _, inv = np.unique(np.concatenate(keys), return_inverse=True)
    values = [np.concatenate([unpack(v[m]) for _, v in parts]) for m in range(len(parts[0][1]))]
    return list(pdf["chunk"]), edge, [np.bincount(inv, v.astype(float)) for v in values], inv


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to every chunk: twice the count, plus 1 where the chunk accounts for the key; and counts of counts."""
    kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
    chunks, edge, (total,), inv = gathered(pdf)
    total = total.astype(np.uint64)
    owner = np.zeros(len(inv), np.uint64)
    owner[np.unique(inv, return_index=True)[1]] = 1
    said = total[inv] * U64(2) + owner
    out = [(c, kind, bucket, pack(said[a:z].astype(np.uint32) if said.size and said.max() < 2**32 else said[a:z])) for c, a, z in zip(chunks, edge, edge[1:])]
    hist = np.bincount(np.minimum(total, RANKS + 1).astype(np.int64), minlength=RANKS + 2)[: RANKS + 1]
    figures = np.array([*hist, int(total.sum()), int((total > 0).sum())], np.int64)
    return pd.DataFrame([*out, (-1, STATS + kind, bucket, figures.tobytes())], columns=["chunk", "kind", "bucket", "blob"])


def normalised(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers for histories: log10 of alpha, and log10 of the factor of seen words (0 unless nothing was discounted)."""
    bucket = int(pdf["bucket"].iloc[0])
    chunks, edge, (mass, lower, count, asks), inv = gathered(pdf)
    c = count / np.maximum(asks, 1)  # every chunk that asks gives the same count
    seen = np.where(c > 0, mass / np.maximum(c, 1), 0)
    none = (c > 0) & (1 - seen < 1e-12)
    factor = np.where(none, c / (c + 1), 1.0)
    left = np.where(none, 1 / (c + 1), np.maximum(1 - seen, 1e-300))
    alpha = np.where(c > 0, left / np.maximum(1 - lower, 1e-300), 1.0)
    a, f = np.log10(alpha)[inv], np.log10(factor)[inv]
    return pd.DataFrame([(k, HISTORY, bucket, pickle.dumps((pack(a[x:y]), pack(f[x:y])))) for k, x, y in zip(chunks, edge, edge[1:])], columns=["chunk", "kind", "bucket", "blob"])


def answers(pdf: pd.DataFrame, kind: int) -> list[bytes]:
    return list(pdf[pdf["kind"] == kind].sort_values("bucket")["blob"])


def score_texts(docs: DataFrame, held: str = "held", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows where ``held`` is false are learnt from."""
    spark = docs.sparkSession
    buckets = n_ranges(docs, RANGE_BYTES, 2)
    texts = written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(held).alias("held")).mapInArrow(tidied(packed), ROW), "texts")

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), b.column(3)):
                c = Chunk(blob.as_py())
                learn = ~c.held[c.text]
                n = np.bincount(c.tokens[learn], minlength=len(c.vocab)).astype(np.uint32)
                for r in asked(name, WORD, c.vocab, [n], buckets):
                    yield rows([r])
                keys, _, inv = c.pairs()
                n = np.bincount(inv[learn], minlength=len(keys)).astype(np.uint32)
                for r in asked(name, PAIR, keys, [n], buckets):
                    yield rows([r])

    counts = written(texts.mapInArrow(tidied(questions), ROW).groupBy("kind", "bucket").applyInPandas(counted, ROW), "counts")
    figures = {WORD: np.zeros(RANKS + 3, np.int64), PAIR: np.zeros(RANKS + 3, np.int64)}
    for r in counts.filter("chunk = -1").collect():  # a row for each hash range
        figures[r["kind"] - STATS] += np.frombuffer(bytes(r["blob"]), np.int64)
    words, pairs = figures[WORD], figures[PAIR]
    model = Model(words[: RANKS + 1], pairs[: RANKS + 1], int(words[RANKS + 1]), int(words[RANKS + 2]))

    released(spark)

    def histories(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf.loc[pdf["kind"] == TEXTS, "blob"].iloc[0])
        n1 = np.concatenate([unpack(b) for b in answers(pdf, WORD)]).astype(np.int64) // 2
        said = np.concatenate([unpack(b) for b in answers(pdf, PAIR)]).astype(np.int64)
        _, at, _ = c.pairs()
        own = (said & 1 == 1) & (said > 1)
        u, v, n2 = c.before[at[own]], c.tokens[at[own]], said[own] // 2
        mass = np.bincount(u, model.discounted(n2), minlength=len(c.vocab))
        lower = np.bincount(u, model.p1(n1[v]), minlength=len(c.vocab))
        given_back()
        out = list(asked(int(pdf["chunk"].iloc[0]), HISTORY, c.vocab, [mass, lower, n1.astype(float), np.ones(len(n1))], buckets))
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "blob"])

    told = texts.unionByName(counts.filter("chunk >= 0"))
    alphas = written(told.groupBy("chunk").applyInPandas(histories, ROW).groupBy("bucket").applyInPandas(normalised, ROW), "alphas")

    released(spark)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf.loc[pdf["kind"] == TEXTS, "blob"].iloc[0])
        n1 = np.concatenate([unpack(b) for b in answers(pdf, WORD)]).astype(np.int64) // 2
        n2 = np.concatenate([unpack(b) for b in answers(pdf, PAIR)]).astype(np.int64) // 2
        ab = [pickle.loads(b) for b in answers(pdf, HISTORY)]
        alpha, factor = (np.concatenate([unpack(x[m]) for x in ab]) for m in range(2))
        _, _, inv = c.pairs()
        sums = np.zeros((3, len(c.size)))
        for a in range(0, len(inv), STEP):  # tokens in steps, so that few arrays are as long as the chunk
            cut = slice(a, a + STEP)
            before, text, pair, known = c.before[cut], c.text[cut], n2[inv[cut]], n1[c.tokens[cut]]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log10(model.discounted(pair) / n1[before]) + factor[before]
                off = alpha[before] + np.log10(model.p1(known))
            base = np.log10((known + 1) / (model.n + (model.v + 1)))
            for k, x in enumerate((known > 0, base, np.where(pair > 0, seen, off))):
                lo = int(text[0])
                part = np.bincount(text - lo, x)
                sums[k, lo : lo + len(part)] += part
        given_back()
        return pd.DataFrame({"doc_id": pd.array(c.ids, "Int64"), "held_out": c.held, "n_tokens": c.size, "n_known": sums[0].astype(np.int64), "train_tokens": model.n, "base_score": sums[1], "score": sums[2]})

    told = texts.unionByName(counts.filter("chunk >= 0")).unionByName(alphas)
    return told.groupBy("chunk").applyInPandas(final, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs.withColumn("held", crc_mod("doc_id", FOLD) == HELD))
