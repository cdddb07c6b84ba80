"""Removal of repeated byte strings by bucket-pointer refinement over a sampled suffix array.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier (smaller
id, or same text and earlier start); strings are judged on the input.

Initial buckets: suffixes are bucketed by their q-gram (``Q`` bytes). Only sampled
suffixes enter: of the q-grams of any ``SPAN`` bytes the one of least hash, so that
equal strings hold an equal sampled suffix at an equal place. A sampled suffix with all
strings around it (its context) is first refined by the identifiers of all its context;
the earliest suffix of a class stands for it, the others are repeats throughout. This
happens within each stretch of texts before the shuffle, so a text or passage with any
number of copies sends one entry a stretch.

Refinement: within a bucket that holds several contexts, the suffixes of all their
offsets are refined by the bucket identifiers at later offsets: depth Q from the q-grams,
2Q from the identifiers at offset Q, and SPAN by reusing the new identifiers at offset
SPAN - 2Q; only buckets with several members are sorted again. Buckets of more than
``HOT`` contexts are split in two by the longer string that either half of the offsets
shares, again and again, so no bucket has to fit a task.

Edge cases: null and empty texts have no bytes and no spans; a null id counts as the
largest; rows of equal id (or null) are ordered by the hash of their text, and of rows
equal in both the first stays; equal texts of several ids differ by id alone; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blobs import pack, pack_sorted, unpack, unpack_sorted
from lodestone.llm.common import BASE, BASE_INV, BYTE_CODE, U64, dropped, mix, n_ranges, powers, slices, text_buffers, written

SPAN, Q = 100, 32
WINDOW = SPAN - Q + 1
LEFT = SPAN - Q
WIDTH = LEFT + SPAN
HOT = 16384
STRETCH = 16 << 20
#: bytes of input for each group of samples or contexts, so that groups do not grow with the input
RANGE_BYTES = 4 << 20
LAST = 2**63 - 1
FIELDS = "doc_id bigint, s int, e int, key bigint, n bigint"


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every w neighbours, by doubling."""
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def sampled(src: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Sampled suffixes of texts src[bounds[i]:bounds[i+1]]: text, offset, q-gram, context, bytes left and right in it."""
    n = len(src)
    if n < SPAN:
        return None
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[src] * powers(BASE, n), out=total[1:])
    back = powers(BASE_INV, n + 1)
    gram = mix((total[Q:] - total[:-Q]) * back[: n - Q + 1])
    least = sliding(gram, WINDOW, np.minimum)
    inside = np.arange(n - SPAN + 1) + SPAN <= np.repeat(bounds[1:], np.diff(bounds))[: n - SPAN + 1]
    least = np.where(inside, least, U64(0))
    edge = np.zeros(WINDOW - 1, U64)
    most = sliding(np.concatenate((edge, least, edge)), WINDOW, np.maximum)
    at = np.flatnonzero((most == gram) & (most > 0))
    text = np.searchsorted(bounds, at, side="right") - 1
    left = np.minimum(LEFT, at - bounds[text])
    right = np.minimum(SPAN, bounds[text + 1] - at)
    context = mix((total[at + right] - total[at - left]) * back[at - left] + (left * 1000 + right).astype(U64) * BYTE_CODE[3])
    return text, at - bounds[text], gram[at], context, left, right


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each document."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((e, s, doc))
    doc, s, e = doc[order], s[order], e[order]
    # a running maximum of ends that starts anew with each document
    rank = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    high = np.maximum.accumulate(e.astype(np.int64) + rank * (1 << 40)) - rank * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > high[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], s[first], high[last].astype(s.dtype)


def classes(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, class and place; where buckets begin; where classes begin."""
    order = np.lexsort((pos, doc, context, gram))
    g, c = gram[order], context[order]
    bucket = np.ones(len(g), bool)
    bucket[1:] = g[1:] != g[:-1]
    return order, bucket, bucket | np.concatenate(([True], c[1:] != c[:-1]))[: len(g)]


def stretches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> spans that repeat within the stretch, and its classes by bucket range."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    names = ["doc_id", "s", "e", "bucket", "blob"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def flush() -> Iterator[pa.RecordBatch]:
        doc, pos, gram, context, left, right = (np.concatenate(x) for x in zip(*held))
        order, _, new = classes(gram, context, doc, pos)
        rest = order[~new]
        d, s, e = merged(doc[rest], (pos - left)[rest].astype(np.int32), (pos + right)[rest].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e), pa.nulls(len(d), kinds[3]), pa.nulls(len(d), kinds[4])], names=names)
        o = order[new]
        edge = np.searchsorted(((gram[o] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64), np.arange(buckets + 1))
        on = np.flatnonzero(np.diff(edge))
        blobs = []
        for b in on:
            x = o[edge[b] : edge[b + 1]]
            parts = [pack_sorted(gram[x]), pack(context[x]), pack(doc[x]), pack(pos[x].astype(np.uint32)), pack(left[x].astype(np.uint8)), pack(right[x].astype(np.uint8))]
            blobs.append(b"".join(len(p).to_bytes(8, "little") + p for p in parts))
        none = pa.nulls(len(on), kinds[1])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(on), kinds[0]), none, none, pa.array(on.astype(np.int32)), pa.array(blobs, kinds[4])], names=names)

    for b in batches:
        data, off = text_buffers(b.column(1))
        ids = b.column(0).to_numpy()
        for i, j in slices(off):
            got = sampled(data[off[i] : off[j]], off[i : j + 1] - off[i])
            size += int(off[j] - off[i])
            if got is not None and len(got[0]):
                held.append((ids[i + got[0]], *got[1:]))
            if size >= STRETCH and held:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def unblob(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return [unpack_sorted(out[0]), *(unpack(x) for x in out[1:])]


def refined_by_context(pdf: pd.DataFrame) -> pd.DataFrame:
    """Over all stretches: spans of later class members, and requests (key, n) for first members in buckets of several classes."""
    gram, context, doc, pos, left, right = (np.concatenate(x) for x in zip(*(unblob(b) for b in pdf["blob"])))
    order, bucket, new = classes(gram, context, doc, pos)
    pos, left, right = (x.astype(np.int64) for x in (pos, left, right))
    rest = order[~new]
    d, s, e = merged(doc[rest], (pos - left)[rest], (pos + right)[rest])
    which = np.cumsum(bucket) - 1
    many = np.bincount(which, new).astype(np.int64)[which]
    ask = new & (many > 1)
    o = order[ask]
    spans = pd.DataFrame({"doc_id": d, "s": s.astype(np.int32), "e": e.astype(np.int32), "key": pd.array([None] * len(d), "Int64"), "n": 0})
    asks = pd.DataFrame({"doc_id": doc[o], "s": pos[o].astype(np.int32), "e": 0, "key": pd.array(gram[o].view(np.int64), "Int64"), "n": many[ask]})
    return pd.concat([spans, asks], ignore_index=True).astype({"s": np.int32, "e": np.int32, "n": np.int64})


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, asks array<struct<s, key, n>> -> a context a row, the sampled suffix at byte LEFT of it."""
    names = ["key", "n", "lo", "hi", "doc_id", "pos", "l", "r", "ctx"]
    for b in batches:
        data, off = text_buffers(b.column(1))
        for i, (doc, asks) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
            text = data[off[i] : off[i + 1]]
            out = []
            for a in asks:
                p = a["s"]
                if p + Q > len(text):
                    continue
                left, right = min(LEFT, p), min(SPAN, len(text) - p)
                row = np.zeros(WIDTH, np.uint8)
                row[LEFT - left : LEFT + right] = text[p - left : p + right]
                out.append((a["key"], a["n"], doc, p, left, right, row.tobytes()))
            if out:
                c = list(zip(*out))
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array([0] * n, pa.int32()), pa.array([LEFT] * n, pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32()), pa.array(c[6], pa.binary())], names=names)


CONTEXT = "key bigint, n bigint, lo int, hi int, doc_id bigint, pos int, l int, r int, ctx binary"


def identifiers(rows: np.ndarray) -> np.ndarray:
    """q-gram identifiers of every offset of every context (rows of WIDTH bytes)."""
    total = np.zeros((len(rows), WIDTH + 1), U64)
    np.cumsum(BYTE_CODE[rows] * powers(BASE, WIDTH), axis=1, out=total[:, 1:])
    return mix((total[:, Q:] - total[:, :-Q]) * powers(BASE_INV, WIDTH + 1)[: WIDTH - Q + 1])


def rank(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New bucket identifiers of sorted pairs, and bucket sizes."""
    _, inv, n = np.unique(pair, return_inverse=True, return_counts=True)
    return inv.ravel().astype(U64), n


def repeats(rows: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, s, e) of strings of SPAN bytes in the contexts that also start earlier in one of them.

    A string that starts d bytes before the sampled suffix is judged for lo <= d <= hi.
    """
    gram = identifiers(rows)
    wide = LEFT + SPAN - 2 * Q + 1  # offsets whose 2Q-byte buckets are used
    twice, n = rank((gram[:, :wide] * U64(0x9E3779B97F4A7C15) ^ mix(gram[:, Q : Q + wide])).ravel())
    multiple = (n > 1)[twice.astype(np.int64)].reshape(len(rows), wide)
    twice = twice.reshape(len(rows), wide)
    col = np.arange(LEFT + 1)
    d = LEFT - col
    ok = (left[:, None] >= d) & (right[:, None] >= SPAN - d) & (d >= lo[:, None]) & (d <= hi[:, None])
    far = SPAN - 2 * Q
    ok &= multiple[:, : LEFT + 1] & multiple[:, far : far + LEFT + 1]
    r, c = np.nonzero(ok)
    if not len(r):
        z = np.zeros(0, np.int64)
        return z, z, z
    ids, n = rank(mix(twice[r, c] * U64(0x9E3779B97F4A7C15)) ^ twice[r, c + far])
    more = n[ids.astype(np.int64)] > 1
    r, c, ids = r[more], c[more], ids[more]
    start = pos[r] - LEFT + c
    order = np.lexsort((start, doc[r], ids))
    ids, who, at = ids[order], doc[r][order], start[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    later = (who != who[head]) | (at != at[head])
    return merged(who[later], at[later], at[later] + SPAN)


def refined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans of a range of buckets, some thousand contexts at a time."""
    pdf = pdf.sort_values("key", kind="stable")
    key = pdf["key"].to_numpy()
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)]))
    num = {c: pdf[c].to_numpy().astype(np.int64) for c in ("doc_id", "pos", "l", "r", "lo", "hi")}
    ctx = pdf["ctx"].to_numpy()
    out, i = [], 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + HOT // 2, side="right")) - 1)
        cut = slice(edge[i], edge[j])
        rows = np.frombuffer(b"".join(ctx[cut]), np.uint8).reshape(-1, WIDTH)
        out.append(repeats(rows, *(num[c][cut] for c in ("doc_id", "pos", "l", "r", "lo", "hi"))))
        i = j
    d, s, e = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"doc_id": d, "s": s.astype(np.int32), "e": e.astype(np.int32)})


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context twice: for either half of its offsets, keyed by the string that all of that half's strings hold."""
    for b in batches:
        lo, hi, left, right = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("lo", "hi", "l", "r"))
        rows = np.frombuffer(b"".join(b.column(b.schema.get_field_index("ctx")).to_pylist()), np.uint8).reshape(-1, WIDTH)
        total = np.zeros((len(rows), WIDTH + 1), U64)
        np.cumsum(BYTE_CODE[rows] * powers(BASE, WIDTH), axis=1, out=total[:, 1:])
        mid = (lo + hi) // 2
        for a, z in ((lo, mid), (mid + 1, hi)):
            on = np.flatnonzero((a <= z) & (left >= a) & (right >= SPAN - z))
            s, e = LEFT - a[on], LEFT + SPAN - z[on]  # shared by all strings of offsets a..z
            key = mix((total[on, e] - total[on, s]) * powers(BASE_INV, WIDTH + 1)[s] + (a[on] * 128 + z[on]).astype(U64) * BYTE_CODE[5])
            t = b.take(pa.array(on))
            cols = {"key": pa.array(key.view(np.int64)), "lo": pa.array(a[on].astype(np.int32)), "hi": pa.array(z[on].astype(np.int32))}
            yield pa.RecordBatch.from_arrays([cols.get(n, t.column(k)) for k, n in enumerate(t.schema.names)], names=t.schema.names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, s, e: byte ranges to remove (they may overlap); docs has doc_id (not null) and text."""
    buckets = n_ranges(docs, RANGE_BYTES)
    passed = written(docs.mapInArrow(lambda it: stretches(it, buckets), "doc_id bigint, s int, e int, bucket int, blob binary"), "passed")
    judged = written(passed.filter("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInPandas(refined_by_context, FIELDS), "judged")
    asks = judged.filter("key is not null").groupBy("doc_id").agg(F.collect_list(F.struct("s", "key", "n")).alias("asks"))
    cut = written(docs.join(asks, "doc_id").select("doc_id", "text", "asks").mapInArrow(contexts, CONTEXT), "contexts")
    spans = [passed.filter("bucket is null").select("doc_id", "s", "e"), judged.filter("key is null").select("doc_id", "s", "e")]
    cold, hot = [cut.filter(F.col("n") <= HOT)], cut.filter(F.col("n") > HOT)
    while hot.limit(1).count():
        split = written(hot.mapInArrow(halves, CONTEXT), "halves")
        sizes = split.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        split = written(split.drop("n").join(sizes, "key").select(*cut.columns), "split")
        cold.append(split.filter((F.col("n") <= HOT)))
        last = split.filter((F.col("n") > HOT) & (F.col("lo") == F.col("hi"))).select("key", "doc_id", (F.col("pos") - F.col("lo")).alias("s"))
        first = last.groupBy("key").agg(F.min(F.struct("doc_id", "s")).alias("first"))
        later = last.join(first, "key").filter(F.struct("doc_id", "s") != F.col("first"))
        spans.append(later.select("doc_id", "s", (F.col("s") + SPAN).alias("e")))
        hot = split.filter((F.col("n") > HOT) & (F.col("lo") < F.col("hi")))
    every = cold[0]
    for c in cold[1:]:
        every = every.unionByName(c)
    found = every.withColumn("range", F.pmod(F.col("key"), F.lit(buckets)).cast("int")).groupBy("range").applyInPandas(refined, "doc_id bigint, s int, e int")
    out = found
    for s in spans:
        out = out.unionByName(s)
    out = written(out, "spans")
    dropped(passed, judged, cut)
    return out


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans array<struct<s, e>>, first -> figures of what goes and what stays, and the text that stays.

    A row that is not the first of equal ones repeats throughout.
    """
    for b in batches:
        data, off = text_buffers(b.column(1))
        cols: list[list] = [[], [], [], [], []]
        for i, (spans, first) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            text = data[off[i] : off[i + 1]]
            gone = np.zeros(len(text) + 1, np.int32)
            if not first and len(text) >= SPAN:
                spans = [{"s": 0, "e": len(text)}]
            for x in spans or ():
                gone[min(x["s"], len(text))] += 1
                gone[min(x["e"], len(text))] -= 1
            out = np.cumsum(gone)[: len(text)] > 0
            kept = text[~out].tobytes()
            runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if len(out) else 0
            for c, v in zip(cols, (len(text), int(out.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def with_keys(own: DataFrame) -> DataFrame:
    """Add key bigint, in the order of ids (null last) and one for each row of its own, and first (false for further equal rows).

    Ids that are told apart are keys themselves. Else the pairs of id and text hash are
    numbered in order; rows equal in both share the first one's key but not ``first``.
    """
    told = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not told.filter((F.col("n") > 1) | (F.col("doc_id") == LAST)).limit(1).count():
        return own.withColumn("key", F.coalesce("doc_id", F.lit(LAST))).withColumn("first", F.lit(True))
    hashed = own.withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    pairs = hashed.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    # numbers of a sorted table grow with its order; once written they stay
    keys = written(pairs.orderBy(F.col("doc_id").asc_nulls_last(), "h").withColumn("key", F.monotonically_increasing_id()), "keys")
    same = (F.col("k.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("k.h") == F.col("r.h"))
    one = hashed.dropDuplicates(["doc_id", "h"])
    rows = one.alias("r").join(keys.alias("k"), same).select("r.doc_id", "r.text", "k.key", F.explode(F.sequence(F.lit(1), "k.n")).alias("copy"))
    return written(rows.select("doc_id", "text", "key", (F.col("copy") == 1).alias("first")), "rows")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    keyed = with_keys(own)
    spans = repeated_spans(keyed.filter("first").select(F.col("key").alias("doc_id"), "text")).groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = spans.withColumnRenamed("doc_id", "key")
    return keyed.join(spans, "key", "left").select("doc_id", "text", "spans", "first").mapInArrow(removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier strings of 100 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).drop("kept")
