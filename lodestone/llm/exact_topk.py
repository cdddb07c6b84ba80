"""Exact top-k search by inner product over norm-bucketed vectors.

Vectors are grouped by length into buckets, and those of a bucket dealt by id into
blocks, longest first in each. A query's k-th best score against the longest vectors is a
lower bound; against a bucket it becomes a local cosine threshold. Where that is over 1
for all of a block of queries, no vector of theirs goes to the bucket. Query blocks move
to the candidate blocks that are left; there, where the threshold is high only a prefix of
the longest vectors is looked at; in between, the query's largest coordinates bound the
product (coordinate pruning); else all are. What is left is verified with exact integer products.

Edge cases: vectors that are null, hold a null or a non-finite component, or have no
id take no part; only vectors of equal dimension meet; an id given to several queries
is one query (its smallest vector), and rows with the query's own id are not its
candidates; other repeated rows are candidates each; ties go to the smaller id; scores
are ranked exactly at any size, and one that does not fit a long is given as the
nearest long; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import n_partitions

#: rows of a block of candidates and of queries
BLOCK, QUERY_BLOCK = 1024, 512
#: vectors of greatest length that give every query its first bound
HEAD = 2048
#: queries whose best partners a task holds at a time
HELD = 1 << 16
FOCUS = 8
EXACT = float(2**53)


def usable(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id bigint, v array<double> (floor(scale * x)), dim int, norm double."""
    x = F.col(vec)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    # doubles of 2**53 and over are whole already
    v = F.transform(x, lambda e: F.when(F.abs(e.cast("double") * scale) < EXACT, F.floor(e.cast("double") * scale).cast("double")).otherwise(e.cast("double") * scale))
    out = df.filter(x.isNotNull() & F.col(id_col).isNotNull()).filter(~bad).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    return out.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors: floats while no sum can pass 2**53."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)))
    with np.errstate(over="ignore", invalid="ignore"):
        if np.sqrt((q * q).sum(axis=1).max()) * np.sqrt((c * c).sum(axis=1).max()) < EXACT:
            return q @ c.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q], dtype=object)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties to the smaller id."""
    if len(ids) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        ids, scores = ids[keep], scores[keep]
    return [(int(s), int(i)) for s, i in heapq.nsmallest(k, zip(scores.tolist(), ids.tolist()), key=lambda x: (-x[0], x[1]))]


def order_key(score: int) -> bytes:
    """Bytes that sort as the scores do, of any size."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\x01" + raw if score >= 0 else b"\x00" + bytes(255 - b for b in raw)


def as_float(score: float) -> float:
    try:
        return float(score)
    except OverflowError:
        return np.inf if score > 0 else -np.inf


def search_block(q: np.ndarray, qn: np.ndarray, qid: np.ndarray, theta: np.ndarray, c: np.ndarray, cn: np.ndarray, cid: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query that the block can serve: its index and its k best in the block; candidates come longest first."""
    longest = cn[0] if len(cn) else 0.0
    slack = 1 + 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * longest > 0, theta / (qn * longest), np.where(theta > 0, np.inf, -np.inf))
    local = np.where(np.isfinite(qn) & np.isfinite(longest) & ~np.isnan(local), local, -np.inf)  # lengths beyond doubles bound nothing
    alive = np.flatnonzero(local <= slack)
    whole = alive[local[alive] < 0.3]
    if len(whole):
        got = products(q[whole], c)
        for r, i in enumerate(whole):
            other = cid != qid[i]
            yield int(i), best(cid[other], got[r][other], k)
    for i in alive[local[alive] >= 0.3]:
        rows = np.arange(np.searchsorted(-cn, -(theta[i] / qn[i]) / slack, side="right"))  # length pruning
        if local[i] < 0.9 and len(rows) > 64:  # coordinate pruning
            focus = np.argsort(-np.abs(q[i]))[:FOCUS]
            part = c[rows][:, focus]
            q_rest = np.sqrt(max(qn[i] ** 2 - (q[i, focus] ** 2).sum(), 0))
            c_rest = np.sqrt(np.maximum(cn[rows] ** 2 - (part**2).sum(axis=1), 0))
            bound = part @ q[i, focus] + q_rest * c_rest
            rows = rows[bound * slack + 1e-6 * abs(theta[i]) >= theta[i]]
        rows = rows[cid[rows] != qid[i]]
        if len(rows):
            yield int(i), best(cid[rows], products(q[i : i + 1], c[rows])[0], k)


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; rows and queries as made by :func:`usable`."""
    spark = rows.sparkSession
    queries = queries.groupBy("id", "dim").agg(F.min(F.struct("v", "norm")).alias("x")).groupBy("id").agg(F.min(F.struct("x", "dim")).alias("x")).select("id", "x.dim", "x.x.v", "x.x.norm")
    parts = n_partitions(spark)
    marks = [i / parts for i in range(1, parts)]
    edges = rows.select(F.percentile_approx("norm", marks, 10000).alias("e")).first()["e"] if marks else None
    edges = sorted(set(edges or []), reverse=True)
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col("norm"))) if edges else F.lit(0)
    # a row a bucket, and there are no more of them than shuffle partitions
    known = rows.groupBy(bucket.alias("bucket")).agg(F.max("norm").alias("top"), F.count("*").alias("n")).collect()
    blocks = {r["bucket"]: -(-r["n"] // BLOCK) for r in known}
    head = rows.orderBy(F.col("norm").desc(), "id").limit(HEAD).select("id", "v", "dim", "norm").toArrow()
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in set(head["dim"].to_pylist()):
        part = head.filter(pa.compute.equal(head["dim"], d))
        heads[d] = (part["id"].to_numpy(), matrix(part["v"], d))
    shared = spark.sparkContext.broadcast(heads)  # HEAD vectors at most

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for d in sorted(set(t["dim"].to_pylist())):
                part = t.filter(pa.compute.equal(t["dim"], d))
                for at in range(0, part.num_rows, QUERY_BLOCK):
                    p = part.slice(at, QUERY_BLOCK)
                    q, ids = matrix(p["v"], d), p["id"].to_numpy()
                    theta = np.full(len(ids), -np.inf)
                    if d in shared.value:
                        cid, c = shared.value[d]
                        got = products(q, c)
                        for r, i in enumerate(ids):
                            top = best(cid[cid != i], got[r][cid != i], k)
                            theta[r] = as_float(top[-1][0]) if len(top) == k else -np.inf
                    qn = p["norm"].to_numpy().astype(float)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        need = np.where((qn > 0) & np.isfinite(qn), theta / qn, np.where(theta > 0, np.inf, -np.inf))
                    need = -np.inf if np.isnan(need).any() or np.isinf(qn).any() else float(need.min())
                    yield pa.RecordBatch.from_arrays([pa.array([need]), pa.array([d], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), q, qn, theta))], names=["need", "dim", "qid", "q", "qn", "theta"])

    def pack_rows(pdf: pa.Table) -> pa.Table:
        """A block's vectors, longest first; one row a dimension."""
        out = []
        for d in sorted(set(pdf["dim"].to_pylist())):
            x = pdf.filter(pa.compute.equal(pdf["dim"], d)).sort_by([("norm", "descending"), ("id", "ascending")])
            out.append((pdf["block"][0].as_py(), d, *(y.tobytes() for y in (x["id"].to_numpy().astype(np.int64), matrix(x["v"], d), x["norm"].to_numpy().astype(float)))))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[m] for r in out], t) for m, t in enumerate(kinds)], names=["block", "dim", "cid", "c", "cn"])

    if not known:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = F.element_at(F.create_map(*[F.lit(x) for b, n in blocks.items() for x in (b, n)]), F.col("bucket"))
    dealt = rows.select("id", "v", "dim", "norm", bucket.alias("bucket")).withColumn("block", F.col("bucket").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), width.cast("bigint")))
    packed_c = dealt.select("block", "id", "v", "dim", "norm").groupBy("block").applyInArrow(pack_rows, "block bigint, dim int, cid binary, c binary, cn binary")
    packed_q = queries.mapInArrow(pack_queries, "need double, dim int, qid binary, q binary, qn binary, theta binary")
    # the buckets that a query block needs, before any vector moves; then their blocks
    bounds = F.array(*[F.struct(F.lit(float(r["top"])).alias("top"), F.lit(r["bucket"]).cast("bigint").alias("b"), F.lit(blocks[r["bucket"]]).cast("bigint").alias("n")) for r in known])
    asked = packed_q.withColumn("x", F.explode(F.filter(bounds, lambda x: x["top"] * (1 + 1e-9) >= F.col("need"))))
    asked = asked.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("x.n") - 1), lambda i: i + F.col("x.b") * (1 << 32)))).drop("x", "need")
    # a stated query set against all rows, block by block
    pairs = packed_c.join(asked.hint("merge"), ["block", "dim"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[int, int]]] = {}

        def told() -> pa.RecordBatch:
            """The best of the queries held, which are then forgotten; the ranking goes over all that tasks tell."""
            rows = [(i, v, max(-(2**63), min(s, 2**63 - 1)), order_key(s)) for i, have in kept.items() for s, v in heapq.nsmallest(k, have, key=lambda x: (-x[0], x[1]))]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[m] for r in rows], pa.binary() if m == 3 else pa.int64()) for m in range(4)], names=["query_id", "vec_id", "score", "key"])

        for b in batches:
            for r in range(b.num_rows):
                at = {n: b.column(m)[r] for m, n in enumerate(b.schema.names)}
                d = at["dim"].as_py()
                num = lambda n, t=np.float64: np.frombuffer(at[n].as_buffer(), t)
                qid, cid = num("qid", np.int64), num("cid", np.int64)
                for i, top in search_block(num("q").reshape(len(qid), d), num("qn"), qid, num("theta"), num("c").reshape(len(cid), d), num("cn"), cid, k):
                    have = kept.setdefault(int(qid[i]), [])
                    have += top
                    if len(have) > 8 * k:
                        have[:] = heapq.nsmallest(k, have, key=lambda x: (-x[0], x[1]))
                if len(kept) > HELD:
                    yield told()
        yield told()

    found = pairs.select("dim", "qid", "q", "qn", "theta", "cid", "c", "cn").mapInArrow(kernel, "query_id bigint, vec_id bigint, score bigint, key binary")
    order = Window.partitionBy("query_id").orderBy(F.col("key").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best partners of every fiftieth vector."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.filter(F.col("id") % 50 == 0), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, v.r,
         coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), o AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, r)::INTEGER AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""
