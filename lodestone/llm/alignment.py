"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

Both tokenizers cut the bytes of one text. Every byte gets a label: no token ends there,
one of A does, one of B does, or both do. A regular expression scans the label string
for spans up to each both-label; the labels counted in a span say how many tokens of
each side make the group. A's and B's tokens of a group are linked, every one with
every other, and a pair of ids counts once for each document that holds it linked.

One pass encodes the texts and makes chunks: the distinct id pairs of some megabytes of
text with the number of documents that hold them, and beside them each document's
pairs by their place in that list. Counts over the corpus are sums over chunks' pairs;
they are joined back to the chunks, so a pair moves once a chunk, however often it occurs.

Edge cases: null and empty texts, and texts whose joined tokens of either side are not
the space and the text (as the second model writes its own space mark as a space), have
no tokens; special tokens' strings inside texts are plain text; repeated rows are
documents of their own, null ids too; texts are encoded whole; groups without a common
end before the text's end grow to it, and their pairs are made from distinct ids, not
from occurrences; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blobs import pack, unpack
from lodestone.llm.common import SLICE_BYTES, dropped, slices, text_buffers, tidied, written

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 1 << 24
#: links of a group that are made from occurrences; a larger group's are made from its distinct ids
WIDE = 1 << 12
# Fixed value: how the byte-level tokenizer cuts text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: white space in a row that the faster library is not given
LONG_BLANK = 100_000
BLANK_RUN = re.compile(rf"\s{{{LONG_BLANK}}}")
#: labels of a byte: no token ends there, one of A, one of B, both
LABELS = np.frombuffer(b".ab=", np.uint8)
SPAN = re.compile(rb"[^=]*=")


def byte_of_char() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizer's JSON file: ids in the order of its merges, whose bytes are merged by rank."""

    def __init__(self, source: bytes):
        given = json.loads(source)
        special = {t["content"] for t in given.get("added_tokens", [])}
        chars = byte_of_char()
        of = {bytes(chars[c] for c in t): i for t, i in given["model"]["vocab"].items() if t not in special}
        self.bytes: list[bytes] = [b""] * (1 + max([*of.values(), *given["model"]["vocab"].values()]))
        for b, i in of.items():
            self.bytes[i] = b
        self._bpe = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=of, special_tokens={})
        self._source, self._slow = source, None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._blank(t) if len(t) > LONG_BLANK and BLANK_RUN.search(t) else self._bpe.encode_ordinary(t) for t in texts]

    def _blank(self, text: str) -> list[int]:
        """The same ids, from the library that reads the file itself: the faster one overflows its stack on such runs."""
        if self._slow is None:
            self._slow = tokenizers.Tokenizer.from_buffer(self._source)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


class PieceModel:
    """A SentencePiece model, which puts a space before the text itself."""

    def __init__(self, source: bytes):
        self._sp = sp = sentencepiece.SentencePieceProcessor(model_proto=source)
        piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._sp.encode(texts, num_threads=1)


@dataclass
class Groups:
    """Tokens of a slice of texts, and their groups.

    a, b: ids; n_a, n_b: tokens by text; per_a, per_b: tokens by group; n_groups: groups by text.
    """

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    per_a: np.ndarray
    per_b: np.ndarray
    n_groups: np.ndarray


def label_string(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> bytes:
    """A label for each of n bytes, from the byte offsets (exclusive) at which tokens end."""
    code = np.zeros(n + 1, np.uint8)
    code[ends_a] |= 1
    code[ends_b] |= 2
    return LABELS[code[1:]].tobytes()


def group_sizes(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group: the labels counted in the spans up to each both-label."""
    ending = labels.translate(None, b".")  # bytes at which nothing ends are in no count
    size = np.fromiter(map(len, SPAN.findall(ending)), np.int64)
    stop = np.cumsum(size)
    kind = np.frombuffer(ending, np.uint8)
    until = lambda one: np.diff(np.concatenate(([0], np.cumsum((kind == one) | (kind == LABELS[3]))))[stop], prepend=0)
    return until(LABELS[1]), until(LABELS[2])


def aligned(texts: list[str], a: ByteLevel, b: PieceModel) -> Groups:
    """The groups of texts, each with a space before it; see the module on texts without tokens."""
    sides = [a.encode([" " + t if t else "" for t in texts]), b.encode(texts)]
    sizes = []
    for k, t in enumerate(texts):
        whole = (" " + t).encode()
        if not t or any(b"".join(map(m.bytes.__getitem__, s[k])) != whole for m, s in zip((a, b), sides)):
            sides[0][k], sides[1][k] = [], []
            sizes.append(0)
        else:
            sizes.append(len(whole))
    ids, counts, ends = [], [], []
    for m, s in zip((a, b), sides):
        counts.append(np.fromiter(map(len, s), np.int64))
        ids.append(np.fromiter(chain.from_iterable(s), np.int64, int(counts[-1].sum())))
        length = np.fromiter(map(len, m.bytes), np.int64)
        ends.append(np.cumsum(length[ids[-1]]))
    per_a, per_b = group_sizes(label_string(ends[0], ends[1], sum(sizes)))
    first = np.searchsorted(np.cumsum(per_a), np.concatenate(([0], np.cumsum(counts[0]))), side="left")
    first = np.where(np.concatenate(([0], np.cumsum(counts[0]))) > 0, first + 1, 0)
    return Groups(ids[0], ids[1], counts[0], counts[1], per_a, per_b, np.diff(first))


class Decimal:
    """Ids as decimals with what follows them, as one list: comma, bar, semicolon."""

    def __init__(self, n: int):
        self.n = n
        self.text = [f"{i}{mark}" for mark in ",|;" for i in range(n)]

    def of(self, g: Groups) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        stop_a, stop_b = np.cumsum(g.per_a), np.cumsum(g.per_b)
        out = np.empty(len(g.a) + len(g.b), np.int64)
        mark_a, mark_b = np.zeros(len(g.a), np.int64), np.zeros(len(g.b), np.int64)
        mark_a[stop_a - 1], mark_b[stop_b - 1] = 1, 2
        out[np.arange(len(g.a)) + np.repeat(stop_b - g.per_b, g.per_a)] = g.a + mark_a * self.n
        out[np.arange(len(g.b)) + np.repeat(stop_a, g.per_b)] = g.b + mark_b * self.n
        at = np.concatenate(([0], np.cumsum(g.n_a + g.n_b)))
        return ["".join(map(self.text.__getitem__, out[x:y].tolist()))[:-1] for x, y in zip(at, at[1:])]


def links(g: Groups, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair (id of A times ``n_b`` plus id of B) and how often the text links it; a row for each text and pair."""
    first_a, first_b = np.cumsum(g.per_a) - g.per_a, np.cumsum(g.per_b) - g.per_b
    text = np.repeat(np.arange(len(g.n_groups)), g.n_groups)
    n = g.per_a * g.per_b
    wide = np.flatnonzero(n > WIDE)
    n[wide] = 0
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    pair = g.a[first_a[group] + k // g.per_b[group]] * n_b + g.b[first_b[group] + k % g.per_b[group]]
    key, times = np.unique(text[group] << 31 | pair, return_counts=True)
    for w in wide.tolist():  # few, and large
        (x, nx), (y, ny) = (np.unique(s[f : f + p], return_counts=True) for s, f, p in ((g.a, first_a[w], g.per_a[w]), (g.b, first_b[w], g.per_b[w])))
        key = np.concatenate((key, (text[w] << 31 | (x[:, None] * n_b + y[None, :])).ravel()))
        times = np.concatenate((times, (nx[:, None] * ny[None, :]).ravel()))
    if len(wide):
        key, inv = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inv, times)
        times = total
    return key >> 31, key & (1 << 31) - 1, times


CHUNK = "chunk bigint, pairs array<int>, docs array<int>, blob binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
_made: dict[str, tuple[ByteLevel, PieceModel]] = {}


def models(a: bytes, b: bytes) -> tuple[ByteLevel, PieceModel]:
    """The tokenizers, made once a worker."""
    name = hashlib.sha256(a).hexdigest() + hashlib.sha256(b).hexdigest()
    if name not in _made:
        _made[name] = (ByteLevel(a), PieceModel(b))
    return _made[name]


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def strings(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Texts of a batch by slices of a bounded size; a null is an empty text."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
    _, off = text_buffers(col)
    for i, j in slices(off, SLICE_BYTES):
        yield i, j, col.slice(i, j - i).to_pylist()


def grouped(docs: DataFrame, a: bytes, b: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, groups array<struct<a array<int>, b array<int>>>: the aligned groups themselves."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))  # as large as the vocabularies

    def lists(ids: np.ndarray, size: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(ids, pa.int32()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = models(*shared.value)
        for batch in batches:
            for i, j, texts in strings(batch, "text"):
                g = aligned(texts, one, two)
                items = pa.StructArray.from_arrays([lists(g.a, g.per_a), lists(g.b, g.per_b)], names=["a", "b"])
                at = pa.array(np.concatenate(([0], np.cumsum(g.n_groups))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, items)], names=["doc_id", "groups"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(kernel), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>>>")


def chunks(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """doc_id bigint, text -> chunks: distinct pairs, the documents that hold each, and the documents' own figures and pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = models(*shared.value)
        n_b = len(two.bytes)
        decimal = Decimal(max(len(one.bytes), n_b))
        name, got, size = TaskContext.get().partitionId() << 24, [], 0

        def flushed() -> pa.RecordBatch:
            ids, figures, sha, per_text, pair, times = zip(*got)
            pairs, at = np.unique(np.concatenate(pair), return_inverse=True)
            blob = pickle.dumps({"ids": list(chain.from_iterable(ids)), "sha": b"".join(chain.from_iterable(sha)), "figures": pack(np.concatenate(figures).ravel()), "per_text": pack(np.concatenate(per_text)), "at": pack(at.astype(np.int32)), "times": pack(np.concatenate(times))})
            lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (pairs, np.bincount(at, minlength=len(pairs)))]
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *lists, pa.array([blob], pa.binary())], names=["chunk", "pairs", "docs", "blob"])

        for batch in batches:
            for i, j, texts in strings(batch, "text"):
                g = aligned(texts, one, two)
                text, pair, times = links(g, n_b)
                per_text = np.bincount(text, minlength=len(texts))
                n_links = np.bincount(text, times, len(texts)).astype(np.int64)
                sha = [hashlib.sha256(s.encode()).digest() for s in decimal.of(g)]
                got.append((batch.column(0).slice(i, j - i).to_pylist(), np.stack((g.n_a, g.n_b, g.n_groups, n_links), 1), sha, per_text, pair, times))
                size += sum(map(len, texts))
                if size >= CHUNK_BYTES:
                    yield flushed()
                    name, got, size = name + 1, [], 0
        if got:
            yield flushed()

    return docs.mapInArrow(tidied(kernel), CHUNK)


def pair_counts(made: DataFrame, n_b: int) -> DataFrame:
    """pair, n_docs, best (no pair of its id of A is in more documents) from chunks."""
    one = made.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n_docs"))
    counts = written(one, "pairs")
    first = F.floor(F.col("pair") / n_b).cast("int")
    top = counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("top"))  # a row an id of A
    out = written(counts.withColumn("a", first).join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best")), "counts")
    dropped(counts)
    return out


def measured(made: DataFrame, counts: DataFrame) -> DataFrame:
    """Figures of every document from its chunk and the counts of the chunk's pairs."""
    asked = made.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "n_docs", "best"))).alias("x"))  # as many as the chunk's pairs
    told = told.select("chunk", "x.n_docs", "x.best")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = pickle.loads(batch.column(0)[k].as_py())
                n, best = (np.asarray(batch.column(c)[k].values if batch.column(c)[k].is_valid else [], t) for c, t in ((1, np.int64), (2, bool)))
                figures, per_text, at, times = (unpack(x[c]) for c in ("figures", "per_text", "at", "times"))
                figures = figures.reshape(-1, 4)
                stop = np.concatenate(([0], np.cumsum(per_text)))
                sums = [np.diff(np.concatenate(([0], np.cumsum(v)))[stop]) for v in (times * best[at], times * n[at])]
                sha = [x["sha"][32 * d : 32 * d + 32].hex() if figures[d, 0] else "" for d in range(len(figures))]
                yield pa.RecordBatch.from_arrays([pa.array(x["ids"], pa.int64()), *(pa.array(figures[:, c]) for c in range(4)), pa.array(sha, pa.string()), *(pa.array(s, pa.int64()) for s in sums)], names=[c.split()[0] for c in RESULT.split(", ")])

    return made.select("chunk", "blob").join(told, "chunk", "left").select("blob", "n_docs", "best").mapInArrow(tidied(kernel), RESULT)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens, and how common its links are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    a, b = file_bytes(BYTE_LEVEL), file_bytes(PIECES)
    made = written(chunks(docs, a, b), "chunks")
    return measured(made, pair_counts(made, len(models(a, b)[1].bytes)))
