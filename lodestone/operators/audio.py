"""Transcripts: offsets, speakers, time spans, merges, quality and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.ranks import DECISION_AUDIO, code, rank


def with_offsets(units: DataFrame, source: str = "source_id", order: str = "unit_id", text: str = "text") -> DataFrame:
    """Character ranges of units when a source's units are joined by line ends."""
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    return units.withColumn("text_start", begin).withColumn("text_end", begin + F.length(text))


def located(spans: DataFrame, units: DataFrame, source: str = "source_id") -> DataFrame:
    """Time range of character spans: from the first to the last unit that each meets, in proportion to the place in the unit.

    spans: source, span_id, start, end; units: source, text_start, text_end, start_time, end_time. A range join within a source.
    """
    s = spans.withColumnRenamed(source, "_s")
    j = s.join(units, (F.col("_s") == F.col(source)) & (F.col("text_end") > F.col("start")) & (F.col("text_start") < F.col("end")))
    size, dur = F.col("text_end") - F.col("text_start"), F.col("end_time") - F.col("start_time")
    at = lambda p: F.col("start_time") + dur * (p - F.col("text_start")) / size
    j = j.withColumn("from", at(F.greatest("start", "text_start"))).withColumn("to", at(F.least("end", "text_end")))
    return j.groupBy(source, "span_id").agg(F.min_by("from", "text_start").alias("start_time"), F.max_by("to", "text_start").alias("end_time"), F.count("*").alias("units"))


def speaker_of(segments: DataFrame, speakers: DataFrame, source: str = "source_id") -> DataFrame:
    """Each segment with the speaker whose turn it overlaps longest; the earliest of equals; speaker_0 where none does."""
    sp = speakers.select(F.col(source).alias("_s"), "speaker_id", F.col("start_time").alias("_a"), F.col("end_time").alias("_b"))
    meets = (F.col("_s") == F.col(source)) & (F.col("_a") < F.col("end_time")) & (F.col("_b") > F.col("start_time"))
    j = segments.join(sp, meets, "left")
    overlap = F.least("_b", "end_time") - F.greatest("_a", "start_time")
    pick = F.max_by("speaker_id", F.struct(overlap.alias("v"), (-F.col("_a")).alias("a")))
    return j.groupBy(source, "segment_id").agg(F.coalesce(pick, F.lit("speaker_0")).alias("speaker_id"))


def padded(spans: DataFrame, pad: Column | float, limit: str = "duration") -> DataFrame:
    """Redaction spans widened by ``pad`` on either side and clipped to the recording."""
    return spans.withColumn("start_time", F.greatest(F.col("start_time") - pad, F.lit(0.0))).withColumn("end_time", F.least(F.col("end_time") + pad, F.col(limit)))


def merged(spans: DataFrame, source: str = "source_id", start: str = "start_time", end: str = "end_time", gap: Column | float | int = 0) -> DataFrame:
    """Spans of a source that touch (or lie at most ``gap`` apart) become one: gaps and islands on the running end."""
    w = Window.partitionBy(source).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    islands = spans.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return islands.groupBy(source, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"))


def asr_quality(units: DataFrame, source: str = "source_id", low: float = 0.65, single: float = 45.0, sparse: float = 12.0, digits: int = 4) -> DataFrame:
    """duration, mean confidence, characters a minute and warnings of each source."""
    q = units.groupBy(source).agg(F.max("end_time").alias("duration"), F.round(F.avg("confidence"), digits).alias("confidence"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("units"))
    rate = F.round(F.when(F.col("duration") > 0, F.col("chars") * 60.0 / F.col("duration")).otherwise(0.0), digits)
    q = q.withColumn("chars_per_minute", rate)
    warn = F.array_compact(F.array(F.when(F.col("confidence") < low, "low_confidence"), F.when((F.col("units") == 1) & (F.col("duration") > single), "single_long_segment"), F.when(F.col("chars_per_minute") < sparse, "sparse_text")))
    return q.withColumn("warnings", F.array_join(warn, ","))


def unit_decision(pii: Column, unsafe: Column, controversial: Column, hard: Column) -> Column:
    """Rank of an audio unit's decision in the audio order."""
    return F.greatest(F.when(unsafe > 0, 3).otherwise(0), F.when(hard | (controversial > 0), 2).otherwise(0), F.when(pii > 3, 1).otherwise(0))


def overall_decision(units: DataFrame, by: list[str], decision: str = "decision") -> DataFrame:
    return units.groupBy(*by).agg(code(F.max(rank(F.col(decision), DECISION_AUDIO)), DECISION_AUDIO).alias("overall"), F.count("*").alias("units"))


def evidence_counters(units: DataFrame, by: str) -> DataFrame:
    """Units, flagged units, distinct speakers and characters of each source."""
    return units.groupBy(by).agg(F.count("*").alias("units"), F.count_if(F.col("flagged")).alias("flagged"), F.countDistinct("speaker_id").alias("speakers"), F.sum(F.length("text")).alias("chars"))


def first_value(*sources: Column) -> Column:
    """The first value that is neither null nor empty: of the manifest, the quality record, the metadata, the probe."""
    return F.coalesce(*[F.when(F.trim(s.cast("string")) != "", s) for s in sources])


def speaker_segments(records: DataFrame, rows: DataFrame) -> DataFrame:
    """source_id, speaker_id, start_time, end_time, confidence, engine: sidecar rows with defaults; a record without any is one segment of speaker_0."""
    j = records.select("source_id", "duration").join(rows.withColumn("_there", F.lit(True)), "source_id", "left")
    end = F.when(F.coalesce("end_time", F.lit(0.0)) == 0, F.col("duration")).otherwise(F.col("end_time"))
    there = F.col("_there").isNotNull()
    return j.select(
        "source_id", F.coalesce(F.when(there, F.when(F.col("speaker_id") != "", F.col("speaker_id"))), F.lit("speaker_0")).alias("speaker_id"), F.coalesce(F.when(there, F.col("start_time")), F.lit(0.0)).alias("start_time"),
        F.when(there, end).otherwise(F.col("duration")).alias("end_time"), F.coalesce(F.when(there, F.col("confidence")), F.lit(0.0)).alias("confidence"), F.when(there, F.coalesce("engine", F.lit("sidecar"))).otherwise("fallback").alias("engine"),
    )


# Families of keywords in the order in which they are asked, with level and category.
FAMILIES = [
    ("unsafe", "violent_content", ["bomb", "kill", "terrorism", "attack", "exploit", "murder", "weapon", "炸弹", "恐怖袭击", "带刀", "拿刀", "堵人", "打死", "杀了", "改成绩", "盗号"]),
    ("controversial", "politically_sensitive", ["political", "protest", "censorship", "classified", "隐瞒", "集合", "游行", "公共事件"]),
    ("unsafe", "sexual_content", ["sex", "porn", "explicit", "nsfw", "色情", "裸聊", "成人聊天群", "露骨"]),
    ("unsafe", "suicide_self_harm", ["自杀", "自残", "轻生", "不想活", "伤害自己", "suicide", "self harm"]),
    ("unsafe", "hate_speech", ["歧视", "外地学生", "滚出学校", "racial hatred", "genocide"]),
]


def moderation(text: Column) -> Column:
    """struct<level, category> of a unit: the first family with a word in the text, else safe."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.struct(F.lit("safe").alias("level"), F.lit("").alias("category"))
    for level, category, words in reversed(FAMILIES):
        met = F.lit(False)
        for w in words:
            met = met | low.contains(w)
        out = F.when(met, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"))).otherwise(out)
    return out
