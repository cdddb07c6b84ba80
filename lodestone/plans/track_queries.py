"""Tracks: line items stand for the points of an order's object, one frame a line number; places come from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import tracks
from lodestone.queries import query, table
from lodestone.tables import Steps


_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line number; points, keys and frames are read from this table, so lines are grouped once."""
    return Steps(spark).keep(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")))


def frames(rows: DataFrame) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    return rows.select(o.alias("asset_id"), (o * 10 + n).alias("frame_id"), (n * 400).alias("pts_ms"), F.lit(400).alias("duration_ms"), F.lit(640.0).alias("width"), F.lit(360.0).alias("height"))


def points(rows: DataFrame) -> DataFrame:
    """One point a line, a second one far off for every third supplier; some know only their time."""
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey"), F.col("l_suppkey")
    near = F.struct(F.lit(0).alias("k"), g.box(p % 50 * 3 + n * 4, s % 60, 40 + p % 30, 30 + s % 20).alias("box"), (p % 100 / 100.0).cast("double").alias("c"))
    far = F.struct(F.lit(1).alias("k"), g.box(p % 50 * 3 + 150 * (s % 4), s % 60 + 40, 80 + p % 60, 30 + s % 20).alias("box"), F.lit(0.9).alias("c"))
    both = F.explode(F.when(s % 3 == 0, F.array(near, far)).otherwise(F.array(near))).alias("x")
    d = rows.select(o.alias("risk_id"), o.alias("asset_id"), n.alias("n"), F.when(p % 5 != 0, o * 10 + n).alias("frame_id"), (n * 400 + 50).alias("pts_ms"), both)
    return d.select("risk_id", "asset_id", (F.col("n") * 2 + F.col("x.k")).alias("ord"), "frame_id", "pts_ms", "x.box", F.col("x.c").alias("confidence"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("risk_id"), g.box(F.lit(60), F.lit(30), F.lit(50), F.lit(40)).alias("box"))


# One frame after another: a state per object, its candidates as lists, the first best of which goes on.
_CAND = f"""pt AS (SELECT l_orderkey AS r, l_linenumber AS n, 0 AS k, (l_partkey % 50 * 3 + l_linenumber * 4)::DOUBLE AS x, (l_suppkey % 60)::DOUBLE AS y, (40 + l_partkey % 30)::DOUBLE AS w, (30 + l_suppkey % 20)::DOUBLE AS h, (l_partkey % 100 / 100.0)::DOUBLE AS c FROM {_LINES}
  UNION ALL SELECT l_orderkey, l_linenumber, 1, (l_partkey % 50 * 3 + 150 * (l_suppkey % 4))::DOUBLE, (l_suppkey % 60 + 40)::DOUBLE, (80 + l_partkey % 60)::DOUBLE, (30 + l_suppkey % 20)::DOUBLE, 0.9::DOUBLE FROM {_LINES} WHERE l_suppkey % 3 = 0),
fr AS (SELECT r, n, dense_rank() OVER (PARTITION BY r ORDER BY n) AS f, list({{'k': k, 'x': x, 'y': y, 'w': w, 'h': h, 'c': c}} ORDER BY k) AS items FROM pt GROUP BY r, n)"""
_O = "greatest(0.0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0.0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"


def _iou(a: str, b: str) -> str:
    o = _O.format(a=a, b=b)
    return f"({o}) / ({a}w * {a}h + {b}w * {b}h - {o})"


def _apart(a: str, b: str) -> str:
    return f"sqrt(({a}x + {a}w / 2 - {b}x - {b}w / 2) ** 2 + ({a}y + {a}h / 2 - {b}y - {b}h / 2) ** 2)"


def _alike(a: str, b: str) -> str:
    return f"least(greatest(1.0, {a}w * {a}h), greatest(1.0, {b}w * {b}h)) / greatest(greatest(1.0, {a}w * {a}h), greatest(1.0, {b}w * {b}h))"


_P = lambda s: s.replace("p.x", "px").replace("p.y", "py").replace("p.w", "pw").replace("p.h", "ph")
_SC = _P(f"{_iou('p.', 'i.')} * 0.45 + greatest(0.0, 1 - {_apart('p.', 'i.')} / greatest(1.0, 4 * sqrt(p.w * p.w + p.h * p.h))) * 0.3 + {_alike('p.', 'i.')} * 0.15 + i.c * 0.1")
_OK = _P(f"seen IS NULL OR (best >= 0.08 AND ({_iou('p.', 'b.')} >= 0.02 OR ({_alike('p.', 'b.')} >= 0.18 AND {_apart('p.', 'b.')} <= greatest(80.0, 4 * sqrt(p.w * p.w + p.h * p.h)))))")
_TRACK = f"""WITH RECURSIVE {_CAND},
t AS (SELECT o_orderkey AS r, 0::BIGINT AS f, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS seen, 60.0::DOUBLE AS px, 30.0::DOUBLE AS py, 50.0::DOUBLE AS pw, 40.0::DOUBLE AS ph, NULL::BIGINT AS n, NULL::INTEGER AS k, NULL::DOUBLE AS c FROM orders
  UNION ALL SELECT r, f, CASE WHEN ok THEN 1 ELSE seen END, CASE WHEN ok THEN b.x ELSE px END, CASE WHEN ok THEN b.y ELSE py END, CASE WHEN ok THEN b.w ELSE pw END, CASE WHEN ok THEN b.h ELSE ph END, n, CASE WHEN ok THEN b.k END, b.c
  FROM (SELECT *, {_OK} AS ok FROM (SELECT *, list_max(sc) AS best, items[list_position(sc, list_max(sc))] AS b FROM (
    SELECT t.r, fr.f, t.seen, px, py, pw, ph, fr.n::BIGINT AS n, items, CASE WHEN t.seen IS NULL THEN [i.c FOR i IN items] ELSE [{_SC} FOR i IN items] END AS sc FROM t JOIN fr ON t.r = fr.r AND fr.f = t.f + 1)))),
z AS (SELECT r AS risk_id, r * 10 + n AS frame_id, n * 400 AS pts_ms, n * 2 + k AS ord, px AS x, py AS y, pw AS w, ph AS h, c AS confidence FROM t WHERE f > 0 AND k IS NOT NULL)"""


@query(_TRACK + " SELECT * FROM z")
def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of each frame that goes on from the last one chosen; points without a frame are placed by their time."""
    rows = lines(spark, sf_dir)
    placed = tracks.placed_points(points(rows), frames(rows))
    return tracks.selected_points(placed, seeds(spark, sf_dir)).select("risk_id", "frame_id", "pts_ms", "ord", "box.*", "confidence")


@query(_TRACK + """, p AS (SELECT r, sum(len(items))::BIGINT AS points, count(*) AS frames, max(len(items)) AS most FROM fr GROUP BY r)
SELECT r AS risk_id, points, coalesce(s, 0) AS selected, concat_ws(',', CASE WHEN most > 1 THEN 'ambiguous_points_same_frame' END, CASE WHEN coalesce(s, 0) < frames THEN 'unstable_track' END) AS flags FROM p LEFT JOIN (SELECT risk_id, count(*) AS s FROM z GROUP BY risk_id) ON r = risk_id""")
def track_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    placed = Steps(spark).keep(tracks.placed_points(points(rows), frames(rows)))
    return tracks.track_flags(placed, tracks.selected_points(placed, seeds(spark, sf_dir)))


_KEYS = f"SELECT l_orderkey AS t, l_linenumber::BIGINT AS n, l_linenumber * 400 AS pts, (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 150)::DOUBLE AS y, (40 + l_partkey % 60)::DOUBLE AS w, (30 + l_suppkey % 50)::DOUBLE AS h, (l_partkey % 100 / 100.0)::DOUBLE AS c, l_suppkey AS s FROM {_LINES}"


def keys(rows: DataFrame) -> DataFrame:
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey"), F.col("l_suppkey")
    return rows.select(o.alias("track_id"), o.alias("asset_id"), (o * 10 + n).alias("frame_id"), (n * 400).alias("pts_ms"), g.box(p % 200, s % 150, 40 + p % 60, 30 + s % 50).alias("box"), (p % 100 / 100.0).cast("double").alias("confidence"), s.alias("s"))


@query(f"""WITH k AS (SELECT *, lead(pts) OVER v AS t2, lead(x) OVER v AS x2, lead(y) OVER v AS y2, lead(w) OVER v AS w2, lead(h) OVER v AS h2, lead(c) OVER v AS c2 FROM ({_KEYS}) WHERE s % 2 = 0 WINDOW v AS (PARTITION BY t ORDER BY n)),
f AS (SELECT t AS a, n AS m, pts AS p FROM ({_KEYS})), j AS (SELECT k.*, m, p, (p - pts) / (t2 - pts)::DOUBLE AS q FROM k JOIN f ON t = a AND p > pts AND p < t2 WHERE t2 - pts <= 1200)
SELECT t AS track_id, t * 10 + n AS frame_id, pts AS pts_ms, x, y, w, h, c AS confidence, 'detected' AS source FROM k
UNION ALL SELECT t, t * 10 + m, p, round(x + (x2 - x) * q, 6), round(y + (y2 - y) * q, 6), round(w + (w2 - w) * q, 6), round(h + (h2 - h) * q, 6), least(c, c2), 'interpolated' FROM j""")
def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    s = tracks.full_series(keys(rows).filter("s % 2 = 0"), frames(rows), 1200)
    return s.select("track_id", "frame_id", "pts_ms", *[F.round(f"box.{d}", 6).alias(d) for d in "xywh"], "confidence", "source")


_GROW = """greatest(0.0, x - greatest(2.0, w * 0.08)) AS x0, greatest(0.0, y - greatest(2.0, h * 0.08)) AS y0, least(640.0, x + w + greatest(2.0, w * 0.08)) AS x1, least(360.0, y + h + greatest(2.0, h * 0.08)) AS y1"""


@query(f"""WITH k AS (SELECT * REPLACE (CASE WHEN s % 4 = 0 THEN (x / 400.0) * 640 ELSE x END AS x, CASE WHEN s % 4 = 0 THEN (y / 300.0) * 360 ELSE y END AS y, CASE WHEN s % 4 = 0 THEN (w / 400.0) * 640 ELSE w END AS w, CASE WHEN s % 4 = 0 THEN (h / 300.0) * 360 ELSE h END AS h) FROM ({_KEYS})),
f AS (SELECT t AS a, n AS m, pts AS p FROM ({_KEYS})), o AS (SELECT DISTINCT t AS op, CASE t % 4 WHEN 0 THEN 'gaussian_blur' WHEN 1 THEN 'pixelate' ELSE 'black_box' END AS mode FROM k WHERE t % 6 <> 5),
j AS (SELECT k.*, n AS m, pts AS at_ms, 'track_redaction' AS source FROM k WHERE t % 3 > 0 AND n % 2 = 1 UNION ALL SELECT k.*, m, pts + s % 600, 'track_redaction' FROM k JOIN f ON t = a AND pts + s % 600 >= p AND pts + s % 600 < p + 400 WHERE t % 3 > 0 AND n % 2 = 0
  UNION ALL SELECT k.*, n, pts, 'operation_region' FROM k WHERE t % 3 = 0)
SELECT op AS operation_id, t * 10 + m AS frame_id, at_ms AS pts_ms, mode, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, CASE WHEN c = 0 THEN 1.0 ELSE c END::DOUBLE AS confidence, source
FROM (SELECT *, {_GROW} FROM j) JOIN o ON t = op WHERE x1 - x0 > 1 AND y1 - y0 > 1""")
def redaction_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders in three have a series, half of it by time alone; the rest have regions. One in six is muted."""
    rows = lines(spark, sf_dir)
    k = keys(rows)
    n, b, part = (F.col("pts_ms") / 400).cast("int"), F.col("box"), F.col("s") % 4 == 0
    box = F.when(part, g.box(b["x"] / 400, b["y"] / 300, b["w"] / 400, b["h"] / 300)).otherwise(b)
    s = k.select(F.col("track_id").alias("operation_id"), F.when((F.col("track_id") % 3 == 0) | (n % 2 == 1), F.col("frame_id")).alias("frame_id"), F.when((F.col("track_id") % 3 == 0) | (n % 2 == 1), F.col("pts_ms")).otherwise(F.col("pts_ms") + F.col("s") % 600).alias("pts_ms"), box.alias("box"), "confidence", F.lit(None).cast("string").alias("source"))
    t = F.col("o_orderkey")
    ops = table(spark, sf_dir, "orders").select(t.alias("operation_id"), t.alias("asset_id"), F.when(t % 6 == 5, "mute").when(t % 4 == 0, "Gaussian_Blur ").when(t % 4 == 1, "pixelate").otherwise("cover").alias("operation"), F.lit("visual").alias("modality"))
    r = tracks.redaction_points(ops, s.filter("operation_id % 3 > 0"), s.filter("operation_id % 3 = 0"), frames(rows))
    return r.select("operation_id", "frame_id", "pts_ms", "mode", *[F.round(f"box.{d}", 6).alias(d) for d in "xywh"], "confidence", "source")
