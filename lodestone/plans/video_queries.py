"""Video operators: a user's events stand for the frames of an asset, in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import audio, video
from lodestone.queries import query, table

_E = """SELECT user_id AS asset_id, event_id AS frame_id, epoch_ns(ts) // 1000000 AS pts_ms, event_type AS route, value, event_id % 7 AS hash FROM events"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("frame_id"), ms.alias("pts_ms"), F.col("event_type").alias("route"), "value", (F.col("event_id") % 7).alias("hash"))


_SEV = "['low', 'medium', 'high', 'critical']"
# Integer arithmetic on a frame's number makes a risk of it: category, modality, whether it is excluded, eligible or without a place.
_CATS = ["content.violence", "privacy.face", "privacy.phone", "visual.poster", "privacy.badge", "privacy.address", "privacy.qr_code", "content.hate", "visual.unknown"]
_MODS = ["visual", "audio", "video_clip", "ocr_text", "safety"]
_R = f"""SELECT asset_id, frame_id AS risk_id, CASE WHEN asset_id % 4 = 0 AND frame_id % 99 = 5 THEN 'content.sexual_minor' WHEN asset_id % 3 = 1 AND frame_id % 9 IN (0, 7) THEN 'visual.poster' ELSE {_CATS}[frame_id % 9 + 1] END AS category,
  {_MODS}[frame_id % 5 + 1] AS modality, pts_ms AS start_ms, pts_ms + 1000 * (frame_id % 900) AS end_ms, {_SEV}[frame_id % 4 + 1] AS severity, (frame_id % 100) / 100.0::DOUBLE AS confidence, frame_id % 3 = 0 AS bare,
  frame_id % 13 = 0 AS excluded, frame_id % 7 <> 1 AS eligible FROM ({_E})"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, a = F.col("frame_id"), F.col("asset_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(s) for s in names]), (k + 1).cast("int"))
    category = F.when((a % 4 == 0) & (f % 99 == 5), "content.sexual_minor").when((a % 3 == 1) & (f % 9).isin(0, 7), "visual.poster").otherwise(pick(_CATS, f % 9))
    return frames(spark, sf_dir).select(
        "asset_id", f.alias("risk_id"), category.alias("category"), pick(_MODS, f % 5).alias("modality"), F.col("pts_ms").alias("start_ms"), (F.col("pts_ms") + 1000 * (f % 900)).alias("end_ms"),
        pick(("low", "medium", "high", "critical"), f % 4).alias("severity"), ((f % 100) / 100.0).alias("confidence"), F.when(f % 3 != 0, g.box(f % 50, f % 40, F.lit(60), F.lit(50))).alias("box"),
        (f % 13 == 0).alias("excluded"), (f % 7 != 1).alias("eligible"), F.lit("").alias("text_span"),
    )


@query(f"""WITH n AS (SELECT *, CASE WHEN lag(route) OVER w IS NOT DISTINCT FROM route THEN 0 ELSE 1 END AS x FROM ({_E}) WINDOW w AS (PARTITION BY asset_id ORDER BY pts_ms, frame_id)),
i AS (SELECT *, sum(x) OVER (PARTITION BY asset_id ORDER BY pts_ms, frame_id)::BIGINT AS segment FROM n)
SELECT asset_id, segment, any_value(route) AS route, min(pts_ms) AS start_ms, max(pts_ms) AS end_ms, count(*) AS frames FROM i GROUP BY asset_id, segment""")
def route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.segments(frames(spark, sf_dir))


@query()
def scene_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.scene_boundaries(frames(spark, sf_dir))


_C = """SELECT c_custkey AS asset_id, 0::BIGINT AS start_ms, (c_custkey % 37) * 1000 + 500 AS end_ms FROM customer"""


@query(f"""SELECT asset_id, clip, clip * 4000 AS clip_start, least(clip * 4000 + 5000, end_ms) AS clip_end FROM (SELECT *, unnest(range(0, greatest(0, ceil((end_ms - 5000) / 4000.0))::BIGINT + 1)) AS clip FROM ({_C}))""")
def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(k.alias("asset_id"), F.lit(0).cast("bigint").alias("start_ms"), ((k % 37) * 1000 + 500).alias("end_ms"))
    return video.clip_windows(s).select("asset_id", "clip", "clip_start", "clip_end")


@query(f"""WITH c AS (SELECT asset_id, clip, lo + clip * 80000000 AS a, least(lo + clip * 80000000 + 100000000, hi) AS b FROM (SELECT *, unnest(range(0, greatest(0, ceil((hi - lo - 100000000) / 80000000.0))::BIGINT + 1)) AS clip
  FROM (SELECT asset_id, min(pts_ms) AS lo, max(pts_ms) + 1 AS hi FROM ({_E}) GROUP BY asset_id)))
SELECT c.asset_id, clip, count(*) AS frames FROM c JOIN ({_E}) e ON e.asset_id = c.asset_id AND pts_ms >= a AND pts_ms < b GROUP BY ALL""")
def clip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    whole = f.groupBy("asset_id").agg(F.min("pts_ms").alias("start_ms"), (F.max("pts_ms") + 1).alias("end_ms"))
    clips = video.clip_windows(whole, 100_000_000, 80_000_000)
    return video.clip_members(clips, f).groupBy("asset_id", "clip").agg(F.count("*").alias("frames"))


@query(f"""WITH p AS (SELECT o_orderkey AS point_id, o_custkey % 15 AS asset_id, 1704067200000 + (o_orderkey % 2592000) * 1000 AS at_ms FROM orders), e AS (SELECT asset_id, pts_ms FROM ({_E}))
SELECT p.asset_id, point_id, CASE WHEN b.pts_ms IS NULL THEN a.pts_ms WHEN a.pts_ms IS NULL THEN b.pts_ms WHEN at_ms - b.pts_ms <= a.pts_ms - at_ms THEN b.pts_ms ELSE a.pts_ms END AS nearest_ms
FROM p ASOF LEFT JOIN e b ON p.asset_id = b.asset_id AND at_ms >= b.pts_ms ASOF LEFT JOIN e a ON p.asset_id = a.asset_id AND at_ms <= a.pts_ms""")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("point_id"), (F.col("o_custkey") % 15).alias("asset_id"), (F.lit(1704067200000) + (k % 2592000) * 1000).alias("at_ms"))
    return video.nearest_frame(p, frames(spark, sf_dir))


_KEYS = "SELECT asset_id AS track_id, pts_ms, (frame_id % 90)::DOUBLE AS x FROM e WHERE frame_id % 5 = 0"


@query(f"""WITH e AS ({_E}), k AS (SELECT *, lead(pts_ms) OVER w AS t1, lead(x) OVER w AS x1 FROM ({_KEYS}) WINDOW w AS (PARTITION BY track_id ORDER BY pts_ms))
SELECT track_id, frame_id, round(x + (x1 - x) * (e.pts_ms - k.pts_ms) / (t1 - k.pts_ms), 6) AS x FROM k JOIN e ON e.asset_id = track_id AND e.pts_ms > k.pts_ms AND e.pts_ms < t1 WHERE t1 - k.pts_ms <= 40000000 AND t1 > k.pts_ms""")
def bbox_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumnRenamed("asset_id", "track_id")
    keys = f.filter("frame_id % 5 = 0").select("track_id", "pts_ms", g.box(F.col("frame_id") % 90, F.lit(0), F.lit(1), F.lit(1)).alias("box"))
    return video.interpolated(keys, f, most=40_000_000).select("track_id", "frame_id", F.round("box.x", 6).alias("x"))


@query(f"SELECT asset_id, frame_id, first_value(frame_id) OVER w AS source_frame, frame_id <> first_value(frame_id) OVER w AS cached FROM ({_E}) WINDOW w AS (PARTITION BY asset_id, hash ORDER BY pts_ms, frame_id)")
def frame_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.cached(frames(spark, sf_dir))


@query(f"""WITH r AS ({_R}), n AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600000 THEN 0 ELSE 1 END AS x FROM r WINDOW w AS (PARTITION BY asset_id, category ORDER BY start_ms, end_ms, risk_id)),
i AS (SELECT *, sum(x) OVER (PARTITION BY asset_id, category ORDER BY start_ms, end_ms, risk_id)::BIGINT AS island FROM n)
SELECT asset_id, category, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, {_SEV}[max(list_position({_SEV}, severity))] AS severity, max(confidence) AS confidence, count(*) AS risks FROM i GROUP BY asset_id, category, island""")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.risk_windows(risks(spark, sf_dir), 3_600_000)


@query()
def temporal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.temporal_merge(risks(spark, sf_dir), 86_400_000)


# Events without a place, all of one kind: their merge is gaps and islands, so that SQL can say it.
@query(f"""WITH r AS (SELECT * FROM ({_R}) WHERE bare AND modality = 'audio'), n AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600000 THEN 0 ELSE 1 END AS x
  FROM r WINDOW w AS (PARTITION BY asset_id, category ORDER BY start_ms, risk_id)), i AS (SELECT *, sum(x) OVER (PARTITION BY asset_id, category ORDER BY start_ms, risk_id) AS island FROM n)
SELECT asset_id, category, 'audio' AS modality, arg_min(risk_id, (start_ms, risk_id)) AS risk_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, {_SEV}[max(list_position({_SEV}, severity))] AS severity, max(confidence) AS confidence, count(*)::INTEGER AS parts FROM i GROUP BY asset_id, category, island""")
def temporal_merge_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.temporal_merge(risks(spark, sf_dir).filter("box is null and modality = 'audio'"), 600_000)


@query(f"SELECT asset_id, arg_max(route, (n, -f)) AS route FROM (SELECT asset_id, route, count(*) AS n, min(pts_ms) AS f FROM ({_E}) GROUP BY ALL) GROUP BY asset_id")
def main_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.main_route(frames(spark, sf_dir))


_C5 = "CASE WHEN NOT excluded AND category = 'content.sexual_minor' THEN 5 WHEN NOT excluded AND starts_with(category, 'content.') THEN 3 WHEN NOT excluded AND eligible AND starts_with(category, 'privacy.') THEN 2 ELSE 1 END"
_GOV = f"""SELECT asset_id, ['allow', 'allow_with_risk_labels', 'transform_required', 'review_required', 'restricted', 'reject'][max(c) + 1] AS decision, bool_or(c IN (3, 5)) AS requires_review,
  coalesce(max(risk_id) FILTER (c = 2), -1) > coalesce(max(risk_id) FILTER (c = 5), -1) AS requires_transformation, count(*) AS risks,
  coalesce(string_agg(DISTINCT CASE c WHEN 5 THEN 'REJECT' WHEN 3 THEN 'REVIEW' WHEN 2 THEN 'PLAN_REDACTION_FOR' END || CASE c WHEN 2 THEN '_ENABLED_OPERATOR_' ELSE '_ENABLED_OPERATOR_' END || upper(replace(category, '.', '_')), ',' ORDER BY CASE c WHEN 5 THEN 'REJECT' WHEN 3 THEN 'REVIEW' WHEN 2 THEN 'PLAN_REDACTION_FOR' END || CASE c WHEN 2 THEN '_ENABLED_OPERATOR_' ELSE '_ENABLED_OPERATOR_' END || upper(replace(category, '.', '_'))), '') AS reasons
FROM (SELECT *, {_C5} AS c FROM ({_R})) GROUP BY asset_id"""


@query(_GOV)
def governance_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.governance(risks(spark, sf_dir))


_PLAN = f"""SELECT asset_id, risk_id, bare, modality, CASE WHEN category = 'privacy.face' THEN 'gaussian_blur' WHEN category IN ('privacy.qr_code', 'privacy.phone', 'privacy.address') THEN 'black_box' WHEN modality = 'audio' THEN 'mute' ELSE 'black_box' END AS operation
FROM ({_R}) WHERE NOT excluded AND eligible AND starts_with(category, 'privacy.') AND (modality = 'audio' OR NOT bare)"""


@query(f"SELECT risk_id, operation FROM ({_PLAN})")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.action_plan(risks(spark, sf_dir)).select("risk_id", "operation")


_QUEUE = f"""SELECT * FROM (SELECT asset_id, risk_id, CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN confidence < 0.65 OR (bare AND modality <> 'audio') OR modality = 'video_clip' THEN 'medium' END AS priority,
  concat_ws(',', CASE WHEN severity IN ('high', 'critical') THEN 'high_severity' END, CASE WHEN confidence < 0.65 THEN 'low_confidence' END, CASE WHEN bare AND modality <> 'audio' THEN 'unlocated' END,
  CASE WHEN starts_with(category, 'privacy.') AND bare AND modality <> 'audio' THEN 'not_redactable' END, CASE WHEN modality = 'video_clip' THEN 'clip_behaviour' END) AS reasons FROM ({_R})) WHERE priority IS NOT NULL"""


@query(f"SELECT risk_id, priority, reasons FROM ({_QUEUE})")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.review_queue(risks(spark, sf_dir)).select("risk_id", "priority", "reasons")


@query(f"""SELECT 'policy_review_' || asset_id AS review_id, asset_id, 'high' AS priority, 'policy_decision' AS review_type FROM ({_GOV}) WHERE requires_review
UNION ALL SELECT 'review_' || risk_id, asset_id, priority, 'risk_annotation' FROM ({_QUEUE}) UNION ALL SELECT 'operation_region_' || risk_id, asset_id, 'medium', 'redaction_region_missing' FROM ({_PLAN}) WHERE bare AND modality <> 'audio'""")
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risks(spark, sf_dir)
    return video.review_items(r, video.governance(r), video.action_plan(r))


@query(f"SELECT asset_id, count(*) AS risks, count(*) FILTER (bare) AS unlocated, count(*) FILTER (confidence < 0.65) AS low_confidence, count(DISTINCT category) AS categories FROM ({_R}) GROUP BY asset_id")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.quality_report(risks(spark, sf_dir))


@query(f"""WITH n AS (SELECT *, CASE WHEN pts_ms <= lag(pts_ms) OVER w + 3600000 THEN 0 ELSE 1 END AS x FROM ({_E}) WINDOW w AS (PARTITION BY asset_id ORDER BY pts_ms)),
i AS (SELECT *, sum(x) OVER (PARTITION BY asset_id ORDER BY pts_ms, frame_id)::BIGINT AS island FROM n) SELECT asset_id, island, min(pts_ms) AS start_time, max(pts_ms) AS end_time, count(*) AS parts FROM i GROUP BY asset_id, island""")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch form of the streaming session merge."""
    f = frames(spark, sf_dir).select("asset_id", F.col("pts_ms").alias("start_time"), F.col("pts_ms").alias("end_time"))
    return audio.merged(f, "asset_id", gap=3_600_000)


@query(f"SELECT asset_id, route, min(frame_id) AS frame_id FROM ({_E}) GROUP BY asset_id, route")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch form of the streaming first-seen rule."""
    return frames(spark, sf_dir).groupBy("asset_id", "route").agg(F.min("frame_id").alias("frame_id"))
