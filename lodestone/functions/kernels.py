"""Arrow kernels for what built-in functions lack: spans of regular expressions, Unicode composition, character shingles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


#: digits (blanks and dashes between them) that any rule for long numbers asks for; the mark of such rules among hints
LONG_NUMBER = re.compile(r"(?:\d[ -]?){7}")
DIGITS = "0-9"
#: texts that a kernel has as Python strings at once
SLICE = 64
#: bins of a sketch
SKETCH = 128
ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(t: str) -> str:
    """Text in which a literal of small letters stands wherever a pattern that ignores case could match it."""
    return t.casefold().replace("\u0131", "i").replace("\u0307", "")


def rule_spans(docs: DataFrame, rules: dict[str, tuple[str, int, int]], text: str = "text", hints: dict[str, tuple[str, ...]] | None = None, around: int = 0) -> DataFrame:
    """doc_id, ord, rule, start, end, match, near of group ``g`` for every match of rules name -> (pattern, flags, g).

    One pass over a text for all rules; patterns are compiled once a worker. A rule with hints runs only on texts that hold
    one of them. ord numbers a document's findings in rule order; near is the match with ``around`` characters on either side.
    """
    hints = hints or {}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(name, re.compile(rx, flags), g, hints.get(name)) for name, (rx, flags, g) in rules.items()]
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                k, low, numbers = 0, folded(t), LONG_NUMBER.search(t) is not None
                for name, rx, g, need in ready:
                    if need is not None and not any(numbers if h == DIGITS else h in low for h in need):
                        continue
                    for m in rx.finditer(t):
                        if m.group(g) is not None:
                            s, e = m.span(g)
                            for c, v in zip(cols, (doc, k, name, s, e, t[s:e], t[max(s - around, 0) : e + around])):
                                c.append(v)
                            k += 1
            kinds = (b.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "ord", "rule", "start", "end", "match", "near"])

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text).mapInArrow(kernel, f"doc_id {key}, ord int, rule string, start int, end int, match string, near string")


def nfc(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a text column in composed form (NFC)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            for k in range(0, b.num_rows, SLICE):  # texts as Python strings are several times as large
                part = b.slice(k, SLICE)
                out = pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in part.column(at).to_pylist()], b.schema.field(at).type)
                yield part.set_column(at, b.schema.field(at), out)

    return docs.mapInArrow(kernel, docs.schema)


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """path, text of binary files: UTF-8 (with or without mark), else GB 18030, else UTF-8 without what is invalid."""

    def text_of(raw: bytes) -> str:
        for name in ("utf-8-sig", "gb18030"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "ignore")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return files.select("path", content).mapInArrow(kernel, "path string, text string")


def shingle_sets(texts: pa.Array, n: int, fold: bool = True) -> pa.ListArray:
    """Hashes of the distinct n-character shingles of each text, lower-cased if ``fold`` (the whole text if shorter)."""

    def hashes(t: str) -> np.ndarray:
        t = t or ""
        c = np.frombuffer((t.lower() if fold else t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        width = min(n, len(c)) or 1
        out = np.full(max(len(c) - width + 1, 1), width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(width, len(c))):
                out = (out ^ c[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        out.sort()  # np.unique hashes whole numbers first, which takes several times as long
        return out[np.concatenate(([True], out[1:] != out[:-1]))].view(np.int64)

    sets = [hashes(t) for t in texts.to_pylist()]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
    flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(offsets, flat)


def shingles(docs: DataFrame, n: int, text: str = "text", fold: bool = True) -> DataFrame:
    """doc_id, g: hashes of the distinct n-character shingles of the text, lower-cased if ``fold`` (the whole text if shorter)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), shingle_sets(b.column(1), n, fold)], names=["doc_id", "g"])

    return docs.select("doc_id", text).mapInArrow(kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, g array<bigint>")


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each by another one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * ODD
        return (x ^ (x >> np.uint64(29))) * ODD


def least_of_bins(x: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of the ascending numbers in each bin, and which bins have one."""
    of = (x % np.uint64(bins)).astype(np.int64)
    least, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    least[of[::-1]] = x[::-1]  # the last one stays
    filled[of] = True
    return least, filled


def band_keys(docs: DataFrame, n: int, bands: int, rows: int, text: str = "text", fold: bool = True, least: float = 0.8) -> DataFrame:
    """doc_id, keys, size, low, high, sketch: the MinHash band keys of each text, the size of its shingle set, and its sketch.

    One-permutation bins keep their least shingle, and the bins of a band make its key. Sets of no more shingles than bins
    (and larger ones that are alike to such a set by ``least``) have the minimum of one permutation a bin instead: bins with one
    shingle or none would make keys of what most texts hold. A byte of each of ``SKETCH`` bins makes the sketch (0 for
    an empty bin), and a bit of each byte makes low and high. Sets stay within the kernel.
    """
    few = bands * rows

    def keys_of(mins: np.ndarray, filled: np.ndarray, kind: int) -> np.ndarray:
        some = filled.reshape(bands, rows).any(axis=1)
        with np.errstate(over="ignore"):
            key = np.where(filled, mixed(mins), np.uint64(0)).reshape(bands, rows).sum(axis=1) * ODD
            key = key + (np.arange(bands) + kind * bands).astype(np.uint64)
            return ((key ^ (key >> np.uint64(32))) * ODD)[some].view(np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mixed(np.arange(1, few + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            keys, ends, sizes, bits, sketches = [np.zeros(0, np.int64)], [0], [], [], []
            for k in range(b.num_rows):
                x = shingle_sets(b.column(1).slice(k, 1), n, fold).values.to_numpy().view(np.uint64)
                own = [keys_of(*least_of_bins(x, few), 0)] if len(x) > few else []
                if len(x) * least <= few + 1e-6:
                    with np.errstate(over="ignore"):
                        own.append(keys_of((x[:, None] * salts).min(axis=0), np.ones(few, bool), 1))
                keys += own
                ends.append(ends[-1] + sum(len(v) for v in own))
                mins, filled = least_of_bins(x, SKETCH)
                sketch = np.where(filled, 1 + mixed(mins) % np.uint64(255), 0).astype(np.uint8)
                sizes.append(len(x))
                bits.append(np.packbits(sketch & 1).view(np.int64))
                sketches.append(sketch.tobytes())
            low, high = np.array(bits, np.int64).reshape(-1, 2).T
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            columns = [b.column(0), lists, pa.array(sizes, pa.int32()), pa.array(low), pa.array(high), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "keys", "size", "low", "high", "sketch"])

    return docs.select("doc_id", text).mapInArrow(kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, keys array<bigint>, size int, low bigint, high bigint, sketch binary")


def alike_in_sketch(pairs: DataFrame, least: float, sure: int = 32) -> DataFrame:
    """a, b of the pairs (a, b, sa, sb) whose sketches agree in a share of ``least`` of the bins that either fills; texts of fewer than ``sure`` bins pass."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in (t.column(2), t.column(3)))
                filled = ((x > 0) | (y > 0)).sum(axis=1)
                same = ((x == y) & (x > 0)).sum(axis=1)
                ok = (filled < sure) | (same >= least * filled)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok))

    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "sa", "sb").mapInArrow(kernel, f"a {kind}, b {kind}")


def alike_rows(t: pa.Table, least: float, sure: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of two parts of each group (or within one part) whose sketches agree as in :func:`alike_in_sketch`."""
    one, two, grp, part = t["one"][0].as_py(), t["two"][0].as_py(), t["grp"].to_numpy(), t["part"].to_numpy()
    x = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    full = x > 0
    order = np.argsort(grp, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], grp[order][1:] != grp[order][:-1], [True])))
    left, right = [], []
    for s, e in zip(edge, edge[1:]):
        own = order[s:e]
        rows, others = own[part[own] == one], own[part[own] == two]
        for k, i in enumerate(rows.tolist()):
            o = others[k + 1 :] if one == two else others
            if len(o):
                filled = (full[o] | full[i]).sum(axis=1)
                same = ((x[o] == x[i]) & full[i]).sum(axis=1)
                near = o[(filled < sure) | (same >= least * filled)]
                left.append(np.full(len(near), i))
                right.append(near)
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))


def alike_in_tile(t: pa.Table, least: float, sure: int = 32) -> pa.Table:
    """a, b (a below b), grp of :func:`alike_rows`."""
    t = t.combine_chunks()
    i, j = alike_rows(t, least, sure)
    ids = t["doc_id"].chunk(0)
    a, b = ids.take(pa.array(i, pa.int64())), ids.take(pa.array(j, pa.int64()))
    low = pc.less(a, b)
    return pa.table({"a": pc.if_else(low, a, b), "b": pc.if_else(low, b, a), "grp": t["grp"].chunk(0).take(pa.array(i, pa.int64()))})


def overlaps(lists: pa.ListArray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of lists of distinct numbers, left by right."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(left), len(right)), np.float32)
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    # numbers of one list alone add nothing
    shared = n > 1
    on = shared[col]
    row, col = row[on], (np.cumsum(shared) - 1)[col[on]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(col, (at, at + width))
        has = np.zeros((len(lists), min(width, int(col[j - 1]) - at + 1)), np.float32)
        has[row[i:j], col[i:j] - at] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def near_rows(pairs: DataFrame, n: int, least: float) -> DataFrame:
    """a, b, jaccard of rows (a, b, left, right) whose texts have n-character shingle sets are alike by ``least`` or more.

    Rows that follow each other with the same left text share its set.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for t in batches:
            out = []
            for k in range(t.num_rows):
                if t.column(0)[k] != last:
                    last, own = t.column(0)[k], shingle_sets(t.column(2).slice(k, 1), n, False).values.to_numpy()
                other = shingle_sets(t.column(3).slice(k, 1), n, False).values.to_numpy()
                if min(len(own), len(other)) < least * max(len(own), len(other)):  # lengths alone rule it out
                    out.append(0.0)
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(both / (len(own) + len(other) - both))
            j = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), j], names=["a", "b", "jaccard"]).filter(pc.greater_equal(j, least))

    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "left", "right").mapInArrow(kernel, f"a {kind}, b {kind}, jaccard double")


def near_in_tile(t: pa.Table, least: float, n: int, fold: bool = True) -> pa.Table:
    """a, b, jaccard of the near pairs between two parts of a group (or within one) that no group of a smaller number gives."""
    t = t.combine_chunks()
    one, two, grp = t["one"][0].as_py(), t["two"][0].as_py(), t["grp"][0].as_py()
    part = t["part"].to_numpy()
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    g, groups = shingle_sets(t["text"].chunk(0), n, fold), t["groups"].chunk(0)
    shared = overlaps(g, left, right)
    size = g.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    near = shared / (size[left][:, None] + size[right][None, :] - shared)
    ok = near >= least
    if one == two:
        ok &= left[:, None] < right[None, :]
    if ok.any():
        below = pa.array([[x for x in xs if x < grp] for xs in groups.to_pylist()], groups.type)
        ok &= overlaps(below, left, right) == 0
    i, j = np.nonzero(ok)
    ids = t["doc_id"].chunk(0)
    return pa.table({"a": ids.take(pa.array(left[i])), "b": ids.take(pa.array(right[j])), "jaccard": pa.array(near[i, j])})
