"""Clip events: a conversation stands for a video, its turns for clip windows with an event, three records and their key frames each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import clips
from lodestone.queries import query, table

_CATS = ["physical_conflict", "normal class", "graphic_violence", "nudity", "extremist symbol", "self_harm", "walking", "weapon threat"]
_WORDS = ["person a", "knife", "contact area", "blood", "face", "chair", "fight", "flag", "participant"]
_BASE = """b AS (SELECT conv_id AS asset_id, turn AS window_id, 0 AS event_id, turn * 4000 AS ws, turn * 4000 + 5000 AS we, length(text) AS n, (conv_id * 3 + turn) AS m FROM conversations)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), t.alias("window_id"), F.lit(0).alias("event_id"), (t * 4000).alias("ws"), (t * 4000 + 5000).alias("we"), F.length("text").alias("n"), (F.col("conv_id") * 3 + t).alias("m"))


def _pick(names: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """events, windows, records, keyframes, members."""
    b, n, m = base(spark, sf_dir), F.col("n"), F.col("m")
    none = F.lit(None)
    events = b.select("asset_id", "window_id", "event_id", _pick(_CATS, m).alias("category"), none.cast("string").alias("label"), F.lit("").alias("activity"), F.lit("seen").alias("evidence"), ((F.col("ws") + n % 7000 - 1000) / 1000).alias("start_s"), F.when(n % 3 != 0, (F.col("ws") + n % 5000) / 1000).alias("end_s"), F.when(n % 4 != 0, (n % 100 / 100.0).cast("double")).alias("confidence"), (m % 2 == 0).alias("review"))
    windows = b.select("asset_id", "window_id", F.col("ws").alias("start_ms"), F.col("we").alias("end_ms"))
    r = b.withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = n + F.col("ord") * 5
    records = r.select("asset_id", "window_id", "event_id", "ord", _pick(_WORDS, k).alias("words"), F.when(k % 4 == 1, g.box(k % 50, k % 30, 20 + k % 10, k % 3 * 10)).alias("box"), F.when(k % 5 != 0, (k % 100 / 100.0).cast("double")).alias("confidence"), (k % 7 == 0).alias("review"), F.when(k % 2 == 0, (F.col("ws") + k % 2000) / 1000).alias("start_s"), F.when(k % 2 == 0, (F.col("ws") + k % 6000) / 1000).alias("end_s"))
    kf = r.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("q", k + F.col("j") * 3).filter("q % 3 <> 0")
    q = F.col("q")
    keyframes = kf.select("asset_id", "window_id", "event_id", "ord", F.when(q % 2 == 0, (F.col("window_id") * 4 + q % 5).cast("int")).alias("frame_index"), F.when(q % 4 == 1, (F.col("ws") + q % 5000) / 1000).alias("time_s"), g.box(q % 60, q % 40, 10 + q % 20, 10 + q % 25).alias("box"), (q % 100 / 100.0).cast("double").alias("confidence"))
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    f = b.select("asset_id", "window_id", "ws", i)
    members = f.select("asset_id", "window_id", (F.col("window_id") * 10 + F.col("i")).alias("frame_id"), (F.col("window_id") * 4 + F.col("i")).cast("int").alias("frame_index"), (F.col("ws") + F.col("i") * 1000).alias("pts_ms"), F.lit(900).alias("duration_ms"))
    return events, windows, records, keyframes, members


def _case(text: str, rows: tuple, k: int, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {w!r})' for w in r[0])} THEN {r[k]!r}" for r in rows) + f" ELSE {other} END"


def _any(text: str, words: tuple) -> str:
    return "(" + " OR ".join(f"contains({text}, {w!r})" for w in words) + ")"


_RISKS = f"""{_BASE}, e0 AS (SELECT *, {_CATS}[m % {len(_CATS)} + 1] AS cat, CASE WHEN n % 4 <> 0 THEN n % 100 / 100.0 WHEN m % 2 = 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence, m % 2 = 0 AS review, ws + n % 7000 - 1000 AS a0, CASE WHEN n % 3 <> 0 THEN ws + n % 5000 ELSE we END AS z0 FROM b),
e1 AS (SELECT *, lower(cat || '  seen') AS tx, CASE WHEN z0 <= a0 THEN ws ELSE a0 END AS a, CASE WHEN z0 <= a0 THEN we ELSE z0 END AS z FROM e0),
e2 AS (SELECT asset_id, window_id, event_id, {_case("tx", clips.EVENTS, 1, "NULL")} AS category, {_case("tx", clips.EVENTS, 2, "NULL")} AS op, confidence, greatest(ws, least(a, we)) AS start_ms, least(z, we) AS z, review, cat IN ('physical_conflict', 'graphic_violence') AS conflict, n, ws FROM e1
  WHERE NOT {_any("tx", clips.CALM)} AND (confidence >= 0.55 OR review)),
e AS (SELECT asset_id, window_id, event_id, category, 'VVIS_' || op AS operator_id, confidence, start_ms, greatest(start_ms + 1, z) AS end_ms, review, conflict, n, ws FROM e2 WHERE category IS NOT NULL)"""


@query(f"WITH {_RISKS} SELECT asset_id, window_id, event_id, category, operator_id, confidence, start_ms, end_ms, review, conflict FROM e")
def clip_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, windows, *_ = tables(spark, sf_dir)
    return clips.clip_risks(events, windows)


_FRAMES = "SELECT asset_id, window_id, window_id * 10 + i AS frame_id, (window_id * 4 + i) AS frame_index, ws + i * 1000 AS pts_ms FROM b, (SELECT unnest([0, 1, 2, 3, 4]) AS i)"


@query(f"""WITH {_RISKS}, f AS ({_FRAMES}), j AS (SELECT e.asset_id, e.window_id, e.event_id, frame_id, pts_ms <= end_ms AND pts_ms + 900 >= start_ms AS inside FROM e JOIN f ON e.asset_id = f.asset_id AND e.window_id = f.window_id)
SELECT asset_id, window_id, event_id, frame_id FROM (SELECT *, bool_or(inside) OVER (PARTITION BY asset_id, window_id, event_id) AS met FROM j) WHERE inside OR NOT met""")
def clip_event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, windows, _, _, members = tables(spark, sf_dir)
    return clips.event_frames(clips.clip_risks(events, windows), members)


_OBJ = f"""WITH {_RISKS}, f AS ({_FRAMES}),
r0 AS (SELECT asset_id, window_id, event_id, o AS ord, conflict, ws, n + o * 5 AS k FROM e, (SELECT unnest([0, 1, 2]) AS o)),
r1 AS (SELECT *, {_WORDS}[k % {len(_WORDS)} + 1] AS words, CASE WHEN k % 5 <> 0 THEN k % 100 / 100.0 WHEN k % 7 = 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS said, k % 7 = 0 AS review, (k % 4 = 1 AND k % 3 > 0) AS boxed, (k % 50)::DOUBLE AS x, (k % 30)::DOUBLE AS y, (20 + k % 10)::DOUBLE AS w, (k % 3 * 10)::DOUBLE AS h FROM r0),
r2 AS (SELECT *, conflict AND NOT {_any("words", clips.WEAPON)} AND NOT {_any("words", clips.WOUND)} AND {_any("words", clips.PERSON)} AS person FROM r1),
kf AS (SELECT asset_id, window_id, event_id, ord, person, CASE WHEN q % 2 = 0 THEN window_id * 4 + q % 5 END AS fi, CASE WHEN q % 4 = 1 THEN ws + q % 5000 END AS tm, (q % 60)::DOUBLE AS x, (q % 40)::DOUBLE AS y, (10 + q % 20)::DOUBLE AS w, (10 + q % 25)::DOUBLE AS h, (q % 100 / 100.0)::DOUBLE AS c FROM (SELECT *, k + j * 3 AS q FROM r2, (SELECT unnest([0, 1]) AS j)) WHERE q % 3 <> 0),
pk AS (SELECT asset_id, window_id, event_id, fi, tm, x, y, w, h, c FROM kf WHERE person UNION ALL SELECT asset_id, window_id, event_id, NULL, NULL, x, y, w, h, said FROM r2 WHERE person AND boxed AND NOT EXISTS (SELECT 1 FROM kf WHERE kf.person AND kf.asset_id = r2.asset_id AND kf.window_id = r2.window_id AND kf.event_id = r2.event_id)),
un AS (SELECT asset_id, window_id, event_id, -1 AS ord, fi, CASE WHEN fi IS NULL THEN tm END AS tm, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(c) AS c FROM pk GROUP BY asset_id, window_id, event_id, fi, CASE WHEN fi IS NULL THEN tm END),
bx AS (SELECT asset_id, window_id, event_id, ord, fi, tm, x, y, w, h, c FROM kf WHERE NOT person UNION ALL SELECT asset_id, window_id, event_id, ord, NULL, NULL, x, y, w, h, CASE WHEN k % 5 <> 0 THEN k % 100 / 100.0 END FROM r2 WHERE NOT person AND boxed UNION ALL FROM un),
fr AS (SELECT bx.*, (SELECT min(frame_id) FROM f WHERE f.asset_id = bx.asset_id AND f.window_id = bx.window_id AND f.frame_index = bx.fi) AS f1, (SELECT arg_min(frame_id, (abs(pts_ms - tm), pts_ms)) FROM f WHERE f.asset_id = bx.asset_id AND f.window_id = bx.window_id AND tm IS NOT NULL) AS f2, window_id * 10 AS f3 FROM bx),
rg AS (SELECT asset_id, window_id, event_id, ord, coalesce(f1, f2, f3) AS frame_id, x, y, w, h, max(c) AS c FROM fr GROUP BY ALL),
ob AS (SELECT asset_id, window_id, event_id, ord, words, said, review, CASE WHEN k % 2 = 0 THEN ws + k % 2000 END AS sa, CASE WHEN k % 2 = 0 THEN ws + k % 6000 END AS sz FROM r2 WHERE NOT person
  UNION ALL SELECT asset_id, window_id, event_id, -1, 'conflict_region', -1.0, bool_or(review), NULL, NULL FROM r2 WHERE person AND EXISTS (SELECT 1 FROM un WHERE un.asset_id = r2.asset_id AND un.window_id = r2.window_id AND un.event_id = r2.event_id) GROUP BY ALL),
oc AS (SELECT ob.*, {_case("words", clips.OBJECTS, 1, "e.category")} AS category, coalesce('VVIS_' || {_case("words", clips.OBJECTS, 2, "NULL")}, e.operator_id) AS operator_id, CASE WHEN said > 0 THEN said ELSE e.confidence END AS confidence, coalesce(sa, e.start_ms) AS a, coalesce(sz, e.end_ms) AS z, e.start_ms AS es, e.end_ms AS ee
  FROM ob JOIN e ON ob.asset_id = e.asset_id AND ob.window_id = e.window_id AND ob.event_id = e.event_id),
oz AS (SELECT oc.asset_id, oc.window_id, oc.event_id, oc.ord, category, operator_id, confidence, CASE WHEN z <= a THEN es ELSE greatest(es, a) END AS start_ms, CASE WHEN z <= a THEN ee ELSE least(ee, z) END AS end_ms, count(*) AS regions FROM oc JOIN rg ON oc.asset_id = rg.asset_id AND oc.window_id = rg.window_id AND oc.event_id = rg.event_id AND oc.ord = rg.ord
  WHERE confidence >= 0.55 OR review GROUP BY ALL)"""


@query(_OBJ + " SELECT * FROM oz")
def clip_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, windows, records, keyframes, members = tables(spark, sf_dir)
    return clips.instances(clips.clip_risks(events, windows), records, keyframes, members)[0].drop("review")


@query(_OBJ + " SELECT rg.asset_id, rg.window_id, rg.event_id, rg.ord, frame_id, x, y, w, h, c AS confidence FROM rg JOIN oz ON oz.asset_id = rg.asset_id AND oz.window_id = rg.window_id AND oz.event_id = rg.event_id AND oz.ord = rg.ord")
def clip_object_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, windows, records, keyframes, members = tables(spark, sf_dir)
    return clips.instances(clips.clip_risks(events, windows), records, keyframes, members)[1].select("asset_id", "window_id", "event_id", "ord", "frame_id", "box.*", "confidence")
