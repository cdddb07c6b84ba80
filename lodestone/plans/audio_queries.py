"""Audio operators: conversations stand for transcripts (a turn is a unit), events for timed turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import audio
from lodestone.queries import query, table
from lodestone.ranks import DECISION_AUDIO, code

# Times of a turn, in whole seconds, from its number and length.
_UNITS = """SELECT conv_id AS source_id, turn AS unit_id, text, role AS speaker_id, (turn * 30)::DOUBLE AS start_time, (turn * 30 + 5 + length(text) % 20)::DOUBLE AS end_time, (50 + length(text) % 50) / 100.0::DOUBLE AS confidence FROM conversations"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("unit_id"), "text", F.col("role").alias("speaker_id"), (F.col("turn") * 30).cast("double").alias("start_time"),
        (F.col("turn") * 30 + 5 + n % 20).cast("double").alias("end_time"), ((50 + n % 50) / 100.0).alias("confidence"),
    )


_OFF = f"SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_start FROM ({_UNITS})"


@query(f"SELECT source_id, unit_id, text_start, text_start + length(text) AS text_end FROM ({_OFF})")
def transcript_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.with_offsets(units(spark, sf_dir)).select("source_id", "unit_id", "text_start", "text_end")


_LOC = f"""WITH u AS (SELECT *, text_start + length(text) AS text_end FROM ({_OFF})), s AS (SELECT source_id AS sid, unit_id AS span_id, text_start + 3 AS a, text_start + length(text) + 4 AS b FROM u),
j AS (SELECT *, start_time + (end_time - start_time) * (greatest(a, text_start) - text_start) / (text_end - text_start) AS f, start_time + (end_time - start_time) * (least(b, text_end) - text_start) / (text_end - text_start) AS t
  FROM s JOIN u ON sid = source_id AND text_end > a AND text_start < b),
l AS (SELECT source_id, span_id, min_by(f, text_start) AS start_time, max_by(t, text_start) AS end_time, count(*) AS units FROM j GROUP BY ALL) """


@query(_LOC + "SELECT source_id, span_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, units FROM l")
def span_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span from the fourth character of each turn into the next turn."""
    u = audio.with_offsets(units(spark, sf_dir))
    spans = u.select("source_id", F.col("unit_id").alias("span_id"), (F.col("text_start") + 3).alias("start"), (F.col("text_end") + 4).alias("end"))
    return audio.located(spans, u).withColumns({c: F.round(c, 6) for c in ("start_time", "end_time")})


@query(_LOC + """, p AS (SELECT source_id, greatest(start_time - 0.2, 0) AS a, end_time + 0.2 AS b FROM l), n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS x FROM p),
i AS (SELECT *, sum(x) OVER (PARTITION BY source_id ORDER BY a, b)::BIGINT AS island FROM n) SELECT source_id, island, round(min(a), 6) AS start_time, round(max(b), 6) AS end_time, count(*) AS parts FROM i GROUP BY source_id, island""")
def merged_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = audio.with_offsets(units(spark, sf_dir))
    spans = u.select("source_id", F.col("unit_id").alias("span_id"), (F.col("text_start") + 3).alias("start"), (F.col("text_end") + 4).alias("end"))
    wide = audio.padded(audio.located(spans, u).withColumn("duration", F.lit(1e9)), 0.2)
    return audio.merged(wide).withColumns({c: F.round(c, 6) for c in ("start_time", "end_time")})


@query(f"""WITH u AS ({_UNITS}), s AS (SELECT source_id AS sid, speaker_id AS sp, start_time - 10 AS a, end_time + (unit_id % 3) * 15 AS b FROM u),
j AS (SELECT source_id, unit_id, sp, least(b, end_time) - greatest(a, start_time) AS v, a FROM u LEFT JOIN s ON sid = source_id AND a < end_time AND b > start_time)
SELECT source_id, unit_id AS segment_id, coalesce(arg_max(sp, (v, -a)), 'speaker_0') AS speaker_id FROM j GROUP BY ALL""")
def speaker_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    turns = u.select("source_id", "speaker_id", (F.col("start_time") - 10).alias("start_time"), (F.col("end_time") + (F.col("unit_id") % 3) * 15).alias("end_time"))
    return audio.speaker_of(u.select("source_id", F.col("unit_id").alias("segment_id"), "start_time", "end_time"), turns)


@query(f"""SELECT source_id, duration, round(c, 9) AS confidence, chars, units, round(r, 9) AS chars_per_minute, concat_ws(',', CASE WHEN round(c, 9) < 0.65 THEN 'low_confidence' END, CASE WHEN units = 1 AND duration > 45 THEN 'single_long_segment' END, CASE WHEN round(r, 9) < 12 THEN 'sparse_text' END) AS warnings
FROM (SELECT *, CASE WHEN duration > 0 THEN chars * 60.0 / duration ELSE 0 END::DOUBLE AS r FROM (SELECT source_id, max(end_time) AS duration, avg(confidence) AS c, sum(length(text))::BIGINT AS chars, count(*) AS units FROM ({_UNITS}) GROUP BY source_id))""")
def asr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.asr_quality(units(spark, sf_dir), digits=9)  # so many digits that no engine meets a tie


@query(f"""SELECT source_id, ['allow', 'quarantine', 'review', 'reject'][max(greatest(CASE WHEN n % 29 = 0 THEN 3 ELSE 0 END, CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 2 ELSE 0 END, CASE WHEN n % 7 > 3 THEN 1 ELSE 0 END)) + 1] AS overall, count(*) AS units
FROM (SELECT source_id, length(text) AS n FROM ({_UNITS})) GROUP BY source_id""")
def unit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    r = audio.unit_decision(n % 7, (n % 29 == 0).cast("int"), (n % 11 == 0).cast("int"), n % 13 == 0)
    return audio.overall_decision(units(spark, sf_dir).withColumn("decision", code(r, DECISION_AUDIO)), ["source_id"])


@query(f"SELECT source_id, count(*) AS units, count(*) FILTER (length(text) % 2 = 0) AS flagged, count(DISTINCT speaker_id) AS speakers, sum(length(text))::BIGINT AS chars FROM ({_UNITS}) GROUP BY source_id")
def audio_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.evidence_counters(units(spark, sf_dir).withColumn("flagged", F.length("text") % 2 == 0), "source_id")
