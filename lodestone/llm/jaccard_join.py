"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct word n-grams. The global order of n-grams is that of
their 64-bit hashes, and is cut into fragments.

Candidates: sets of sizes that can reach the threshold differ in at most t n-grams, so
of more than t fragments at least one is equal in both. Each set emits one signature per
filled fragment (the fragment's whole content), in the size band of its own and in the
next lower one. A passage that many texts share makes no candidate unless everything
else in that stretch of the order is equal too.

Verification: sets are cut into ``CUTS`` fragments; partial overlaps are counted per
fragment and pair, and summed per pair.

Within the texts that share signatures not all pairs are made. Each is compared with its
pivots (the least class of each key); links join components. Of the stars of a pivot that
still hold several components, pairs of different ones are looked at in blocks through
sketches (content sums of about as many fragments as a set has n-grams): sets that differ
in more fragments than they may differ in n-grams cannot link. In rounds each class
verifies the nearest pair left, and pairs that links have joined meanwhile go; at last all
that are left are verified, so no link between components is lost.

Edge cases: null and empty texts, or texts without words, have an empty set, no links and
their own id as component; fewer words than n give one n-gram of all words; equal
rows are one class; a null id takes part as a text but counts as the largest id;
extra columns are ignored. Classes are identified by a 128-bit hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blobs import pack, pack_sorted, unpack, unpack_sorted
from lodestone.llm.common import U64, Words, among, bitmap, dropped, in_bitmap, mix, n_ranges, slices, text_buffers, tidied, written

CUTS = 4
#: least and most fragments of a sketch, as powers of two
FINE = (5, 13)
CLUSTER_BLOCK = 512
FLUSH = 1 << 20
#: input bytes a bucket range of signatures
BUCKET_BYTES = 4 << 20
#: rounds in which each class verifies its nearest pairs, before all that are left are verified
ROUNDS = 2
SALTS = 16
PAIRS = "a binary, b binary, both bigint, apart bigint"
ODD = [U64(x) for x in (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def sets_of(data: np.ndarray, off: np.ndarray, i: int, j: int, n: int) -> list[np.ndarray]:
    """For each text its n-gram hashes, distinct and in order."""
    w = Words(data, off, i, j)
    h = w.hash
    gram = np.zeros(max(len(h) - n + 1, 0), U64)
    for k in range(n):
        gram += h[k : len(gram) + k] * ODD[k]
    gram = mix(gram)
    out = []
    for a, z in zip(w.first, w.first[1:]):
        if z - a >= n:
            out.append(np.unique(gram[a : z - n + 1]))
        elif z > a:
            out.append(mix(np.array([sum(int(h[a + k]) * int(ODD[k]) for k in range(z - a)) + int(z - a)], dtype=object).astype(object) % (1 << 64)))
        else:
            out.append(np.zeros(0, U64))
    return out


class Bands:
    """Size bands such that partners are in the same or adjacent ones, for threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def apart(self, band: int) -> int:
        """The most n-grams in which a set of this band and a larger partner can differ."""
        self.of(self.low[band] if band < len(self.low) else 1)
        top = self.low[band] * self.den // self.num
        return top * (self.den - self.num) // self.num


def fragment_sums(h: np.ndarray, m: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Content hash and size of each of m fragments of a set's order (salted: of another order)."""
    order = np.sort(mix(h + U64(salt))) if salt else h
    at = ((order >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
    edge = np.searchsorted(at, np.arange(m + 1))
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(order ^ ODD[0]), out=total[1:])
    return total[edge[1:]] - total[edge[:-1]], np.diff(edge)


def signatures(h: np.ndarray, bands: Bands, levels: int = 4) -> np.ndarray:
    """Keys of a set; sets over the threshold share at least one.

    If partners differ in at most t n-grams, at most t of m fragments differ. While more
    than t of a set's fragments are filled, one that is equal is filled. A set with fewer
    adds the fragments of another order, level by level; partners that need a level both have it.
    """
    if not len(h):
        return np.zeros(0, U64)
    own = bands.of(len(h))
    out = []
    for band in {own, max(own - 1, 0)}:
        t = bands.apart(band)
        m = t + 3 + t // 10
        for level in range(levels):
            content, size = fragment_sums(h, m, level)
            place = mix(np.arange(m, dtype=U64) * ODD[1] + U64(band * 0x9E3779B1 + level * 0x85EBCA77))
            full = size > 0
            out.append(mix(content[full] * ODD[2] + place[full]))
            if full.sum() > t:
                break
        else:
            out.append(mix(place[~full]))
    return np.unique(np.concatenate(out))


def set_id(s: np.ndarray) -> bytes:
    """128-bit hash of a set."""
    a, b = mix(s ^ ODD[3]).sum(dtype=U64) + U64(len(s)), mix(s ^ ODD[4]).sum(dtype=U64)
    return mix(np.array([a, b], U64)).tobytes()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (smallest node reached), by smallest neighbour and pointer jumping over written tables."""
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = written(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("old")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        dropped(labels)
        kept = new.select("node", "label")
        kept._lodestone_path = new._lodestone_path
        labels = kept
        if not moved:
            dropped(both)
            return labels


def packed_keys(keys: list[np.ndarray], first: int, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Bucket ranges, and for each its keys (upper 48 bits, as differences) with their owners, numbered from ``first``."""
    k = np.concatenate(keys)
    own = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) for x in keys])
    order = np.argsort(k, kind="stable")
    k, own = k[order], own[order]
    edge = np.searchsorted(((k >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64), np.arange(buckets + 1))
    on = np.flatnonzero(np.diff(edge))
    blobs = []
    for b in on:
        cut = slice(edge[b], edge[b + 1])
        part = pack_sorted(k[cut] >> U64(16))
        blobs.append(first.to_bytes(8, "little") + len(part).to_bytes(8, "little") + part + pack(own[cut].astype(np.uint16) if len(keys) < 1 << 16 else own[cut]))
    return on, blobs


def stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket range: each text's number with the least number that it shares a key with (pivot)."""
    ks, cs = [], []
    for blob in pdf["blob"]:
        n = int.from_bytes(blob[8:16], "little")
        ks.append(unpack_sorted(blob[16 : 16 + n]))
        cs.append(unpack(blob[16 + n :]).astype(np.int64) + int.from_bytes(blob[:8], "little"))
    k, c = np.concatenate(ks), np.concatenate(cs)
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    pair = np.unique(np.column_stack([c[head[~first]], c[~first]]), axis=0)
    pair = pair[pair[:, 0] != pair[:, 1]]
    return pd.DataFrame({"pivot": pair[:, 0], "node": pair[:, 1]})


def jaccard_classes(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set; null for empty sets), component_id."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    buckets = n_ranges(docs, BUCKET_BYTES)
    flush_at = max(FLUSH, 8 * buckets)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        keys: list[np.ndarray] = []
        seen: set[bytes] = set()
        held, first = 0, TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            on, blobs = packed_keys(keys, first, buckets)
            none = pa.nulls(len(on), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(on), pa.binary()), none, pa.array(on.astype(np.int32)), pa.array(blobs, pa.binary())], names=names)

        names = ["doc_id", "n", "cid", "node", "bucket", "blob"]
        for b in batches:
            data, off = text_buffers(b.column(1))
            for i, j in slices(off):
                sets = sets_of(data, off, i, j, n)
                ids = [set_id(s) if len(s) else None for s in sets]
                nodes: list[int | None] = []
                for s, cid in zip(sets, ids):
                    new = cid is not None and cid not in seen  # a class once in a stretch
                    nodes.append(first + len(keys) if new else None)
                    if new:
                        seen.add(cid)
                        keys.append(signatures(s, bands))
                        held += len(keys[-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(nodes, pa.int64()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=names)
                if held >= flush_at:
                    yield from flush()
                    keys, seen, held, first = [], set(), 0, first + len(keys)
        if held:
            yield from flush()

    passed = written(docs.mapInArrow(tidied(first_pass), "doc_id bigint, n bigint, cid binary, node bigint, bucket int, blob binary"), "passed")
    shared = passed.filter("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInPandas(stars, "pivot bigint, node bigint")
    edges = written(shared.distinct(), "stars")
    rows = written(passed.filter("bucket is null").select("doc_id", "n", "cid", "node"), "rows")
    dropped(passed)
    named = rows.filter("node is not null").select("node", "cid")
    pairs = edges.join(named.hint("merge"), "node").select("pivot", "cid").join(named.toDF("pivot", "own").hint("merge"), "pivot")
    pairs = written(pairs.filter("own != cid").select(F.col("own").alias("pivot"), "cid").distinct(), "pairs")
    dropped(edges)
    classes = written(rows.filter("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep")), "classes")
    labels = linked(docs, pairs, classes, n, num, den)
    known = classes.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    comp = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = known.join(comp, "label").select("cid", "rep", "component_id")
    out = rows.select("doc_id", "n", "cid").join(known, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def sketch(s: np.ndarray) -> bytes:
    """A byte of content sum for each of so many fragments as the set's size allows (a power of two).

    Sums add up: neighbouring fragments of a finer sketch give a coarser one.
    """
    m = 1 << min(max(len(s).bit_length() - 1, FINE[0]), FINE[1])
    total = np.zeros(len(s) + 1, U64)
    np.cumsum(mix(s ^ ODD[5]) >> U64(32), out=total[1:])
    edge = np.searchsorted(s, np.arange(m, dtype=U64) << U64(64 - (m.bit_length() - 1)))
    edge = np.append(edge, len(s))
    return (total[edge[1:]] - total[edge[:-1]]).astype(np.uint8).tobytes()


def near_in_sketch(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Pairs of a block of a star (or of two blocks) in different components whose sketches let them link, and how far they differ.

    A pair of several common stars is given by the one of the least number alone.
    """
    star, cid, n, part = pdf["star"].to_numpy(), pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["part"].to_numpy()
    every, lower = pdf["stars"].to_numpy(), {}

    def below(i: int) -> frozenset[int]:
        """The stars of a class that have smaller numbers than the one at hand."""
        if i not in lower:
            lower[i] = frozenset(every[i][every[i] < star[i]].tolist())
        return lower[i]

    halves = int(pdf["one"].iloc[0]) != int(pdf["two"].iloc[0])
    label = pd.factorize(pdf["label"])[0]
    text = pdf["sketch"].to_numpy()
    fine = np.array([len(x) for x in text])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort((fine, star))
    edge = np.flatnonzero(np.concatenate(([True], (star[order][1:] != star[order][:-1]) | (fine[order][1:] != fine[order][:-1]), [True])))
    groups = {(star[order[a]], fine[order[a]]): order[a:z] for a, z in zip(edge, edge[1:])}
    for (own, wide), rows in groups.items():
        for also in (wide, 2 * wide):  # partners' sizes differ by less than twice
            others = groups.get((own, also))
            if others is None or (also == wide and len(rows) == 1):
                continue
            if label[rows[0]] == label[others[0]] and (label[rows] == label[rows[0]]).all() and (label[others] == label[rows[0]]).all():
                continue
            x = np.frombuffer(b"".join(text[rows]), np.uint8).reshape(len(rows), wide)
            y = x if also == wide else np.frombuffer(b"".join(text[others]), np.uint8).reshape(len(others), wide, 2).sum(axis=2, dtype=np.uint8)
            for k, i in enumerate(rows):
                ok = (label[others] != label[i]) & (np.minimum(n[others], n[i]) * den >= np.maximum(n[others], n[i]) * num)
                if halves:
                    ok &= part[others] != part[i]
                if also == wide:
                    ok[: k + 1] = False
                j = np.flatnonzero(ok)
                if len(j):
                    apart = (y[j] != x[k]).sum(axis=1)
                    near = apart <= (n[others[j]] + n[i]) * (den - num) // (den + num)
                    near[near] = [below(i).isdisjoint(below(o)) for o in others[j[near]].tolist()]
                    found.append((np.full(int(near.sum()), i), others[j[near]], apart[near]))
    i, j, apart = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    low = np.array([cid[a] <= cid[b] for a, b in zip(i, j)], bool)
    a, b = np.where(low, i, j), np.where(low, j, i)
    return pd.DataFrame({"a": cid[a], "b": cid[b], "both": n[a] + n[b], "apart": apart}).drop_duplicates(["a", "b"])


def star_pairs(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Of classes and pivots with their sketches, the pairs that may link."""
    rows = []
    for p, c, n, m, x, y in zip(pdf["pivot"], pdf["cid"], pdf["n"], pdf["m"], pdf["sketch"], pdf["also"]):
        u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        if len(u) < len(v):
            v = v.reshape(-1, len(v) // len(u)).sum(axis=1, dtype=np.uint8)
        elif len(v) < len(u):
            u = u.reshape(-1, len(u) // len(v)).sum(axis=1, dtype=np.uint8)
        apart = int((u != v).sum())
        if apart <= (n + m) * (den - num) // (den + num):
            rows.append((min(p, c), max(p, c), n + m, apart))
    return pd.DataFrame(rows, columns=["a", "b", "both", "apart"])


def fetched(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """cid, src, f, grams (of each of CUTS fragments) and sketch (with the first) of the member classes, and perhaps of others.

    src tells rows of equal sets apart.

    Texts are not moved: a bitmap of fixed size says which ids may be asked for, and the
    rest of the rows go no further than their task.
    """
    may = bitmap(members.filter("rep is not null"), "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        src = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column(0)
            b = b.filter(pa.array(ids.is_null().to_numpy(zero_copy_only=False) | in_bitmap(may.value, ids.fill_null(0).to_numpy())))
            data, off = text_buffers(b.column(1))
            for i, j in slices(off):
                rows = []
                for s in sets_of(data, off, i, j, n):
                    cid = set_id(s) if len(s) else None
                    if cid is not None and cid not in seen:
                        seen.add(cid)
                        edge = np.searchsorted((s >> U64(62)).astype(np.int64), np.arange(CUTS + 1))
                        rows += [(cid, src, f, s[edge[f] : edge[f + 1]].view(np.int64), sketch(s) if f == 0 else None) for f in range(CUTS)]
                        src += 1
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["cid", "src", "f", "grams", "sketch"])

    return docs.mapInArrow(tidied(cut), "cid binary, src bigint, f int, grams array<bigint>, sketch binary")


def linked(docs: DataFrame, edges: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, label of the classes that may have links; edges: pivot, cid of classes that share keys.

    Joins whose sides grow with the input are merged at every size.
    """
    spark = docs.sparkSession
    if not edges.limit(1).count():
        return spark.createDataFrame([], "node binary, label binary")
    members = written(edges.select("cid").union(edges.select("pivot")).distinct().join(classes, "cid"), "members")
    fragments = written(fetched(docs, members, n), "fragments")
    # of equal sets that were cut in several tasks one stands
    stand = fragments.filter("sketch is not null").select("cid", "src").groupBy("cid").agg(F.min("src").alias("src"))
    stand = stand.join(members.select("cid", "n").hint("merge"), "cid")
    sketches = written(fragments.filter("sketch is not null").select("cid", "src", "sketch").join(stand.hint("merge"), ["cid", "src"]), "sketches")
    nodes = members.select(F.col("cid").alias("node"))
    links: list[DataFrame] = []

    def verified(pairs: DataFrame) -> None:
        """Partial overlaps are counted per fragment, and summed per pair; what links is kept."""
        asked = written(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(sketches.select("cid", "src").hint("merge"), "cid"), "asked")
        # sets that nobody asks for stay in their task
        own = fragments.select("cid", "src", "f", "grams").filter(among(bitmap(asked, "src"), F.col("src"))).join(asked, ["cid", "src"], "left_semi").drop("src")
        one, two = own.toDF("a", "f", "ga"), own.toDF("b", "f", "gb")
        partial = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), ["b", "f"]).select("a", "b", "both", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
        found = partial.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("both").alias("both"))
        links.append(written(found.filter(F.col("o") * (num + den) >= F.col("both") * num).select("a", "b"), "links"))
        dropped(asked)

    def labelled(old: DataFrame | None) -> DataFrame:
        """Components of the links so far; of several rounds, of the labels that the last round's links join."""
        if old is None:
            return written(nodes.join(components(links[-1]), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
        ends = links[-1].join(old.toDF("a", "x"), "a").join(old.toDF("b", "y"), "b").filter("x != y").select("x", "y").distinct()
        new = written(old.join(components(ends, "x", "y").toDF("label", "low"), "label", "left").select("node", F.coalesce("low", "label").alias("label")), "labels")
        dropped(old)
        return new

    # every class with its pivots
    side = sketches.select("cid", "n", "sketch")
    near = edges.join(side.hint("merge"), "cid").join(side.toDF("pivot", "m", "also").hint("merge"), "pivot").filter(F.least("n", "m") * den >= F.greatest("n", "m") * num)
    near = near.mapInPandas(lambda it: (star_pairs(p, num, den) for p in it), PAIRS)
    verified(written(near, "near"))
    labels = labelled(None)
    # stars that still hold several components: a pair that shares a key is in the star of that key's pivot
    each = edges.select("pivot", "cid").union(edges.select("pivot", F.col("pivot")).distinct()).join(labels.toDF("cid", "label"), "cid")
    open_ = each.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / CLUSTER_BLOCK).cast("int").alias("blocks")).filter("lo != hi").select("pivot", "blocks")
    # a large star is one key: both sides are salted
    salted = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = each.withColumn("salt", F.pmod(F.hash("cid"), F.lit(SALTS))).join(salted, ["pivot", "salt"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    work = held.withColumn("other", other).withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))
    stars_of = each.join(open_.select("pivot"), "pivot").groupBy("cid").agg(F.collect_set(F.xxhash64("pivot")).alias("stars"))  # as many as a class has keys
    work = work.join(side.hint("merge"), "cid").join(stars_of.hint("merge"), "cid").select(F.xxhash64("pivot").alias("star"), "stars", "blocks", "one", "two", "part", "cid", "n", "label", "sketch")
    # small stars of a range share a task; a star of several blocks has a task for each two of them
    ranges = n_ranges(docs, BUCKET_BYTES)
    work = work.withColumn("range", F.when(F.col("blocks") > 1, F.col("star")).otherwise(F.pmod(F.col("star"), F.lit(ranges))))
    near = work.groupBy("range", "one", "two").applyInPandas(lambda pdf: near_in_sketch(pdf, num, den), PAIRS)
    left = written(near.dropDuplicates(["a", "b"]), "near")
    dropped(edges)
    for turn in range(ROUNDS + 1):
        # pairs that other links have joined meanwhile need no look; each class verifies its nearest pairs first
        apart = left.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la != lb").select("a", "b", "both", "apart")
        held = written(apart, "left")
        dropped(left)
        left = held
        if not left.limit(1).count():
            break
        if turn == ROUNDS:
            pick = left
        else:
            best = F.min(F.struct("apart", "a", "b", "both"))
            pick = left.groupBy(F.col("a").alias("x")).agg(best.alias("p")).union(left.groupBy(F.col("b").alias("x")).agg(best.alias("p"))).select("p.a", "p.b", "p.both").distinct()
            pick = written(pick, "pick")
        verified(pick.select("a", "b", "both"))
        labels = labelled(labels)
        if turn < ROUNDS:
            left = left.join(pick.select("a", "b"), ["a", "b"], "left_anti")
    dropped(fragments, members, sketches, *links)
    return labels


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-word shingles, similarity of 0.9 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs, n=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), c AS (
  SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh
), e AS (
  SELECT rep, n, unnest(sh) AS g FROM c
), o AS (
  SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, count(*) AS o
  FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY ALL
), l AS (
  SELECT x, y FROM o WHERE 100 * o >= 90 * (na + nb - o)
), d AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT rep AS node, rep AS root FROM c
  UNION
  SELECT d.y, r.root FROM r JOIN d ON r.node = d.x
), m AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND list_sort(s.sh) = c.sh LEFT JOIN m ON m.node = c.rep
"""
