"""What an event recogniser says of clips: its events as risks, and the objects it names as tracks' first boxes.

Events, their records (objects of an event) and the records' key frames are tables; a
clip window is a key, so everything is joins and groupings by window. Times of a
recogniser are seconds, those of a timeline milliseconds.

Edge cases: unknown or calm events give nothing; null words are empty; a span that ends
before it starts is the window's; boxes without size are none; records without any box
in a frame of their window give nothing; repeated boxes of a frame count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import video
from lodestone.tables import Steps

EVENT = ["asset_id", "window_id", "event_id"]
LEAST = 0.55

# Words of calm scenes, words of each category of events and of objects in order, with the operator that stands for it.
CALM = ("normal", "education", "teacherlecture", "studentactivity", "groupdiscussion", "transition", "正常", "教学", "课堂")
EVENTS = (
    (("graphic_violence", "weapon", "fight", "assault", "physical_conflict", "violence", "斗殴", "打架", "暴力", "肢体冲突", "攻击", "武器"), "content.graphic_violence", "CSA_003"),
    (("sexual", "porn", "nudity", "exposure", "裸露", "色情", "低俗"), "content.sexual", "CSA_002"),
    (("hate", "nazi", "extremist", "terror", "symbol", "仇恨", "极端", "纳粹", "恐怖", "符号"), "content.hate", "CSA_004"),
    (("self_harm", "suicide", "自伤", "自杀"), "content.self_harm", "CSA_006"),
)
OBJECTS = (
    (("face", "人脸"), "privacy.face", "VPI_001"),
    (("text", "ocr", "文字", "文本"), "privacy.screen_sensitive", "PII_009"),
    (("weapon", "gun", "knife", "pistol", "rifle", "枪", "刀", "武器"), "content.graphic_violence", "CSA_003"),
    (("exposed", "nude", "sexual", "breast", "genital", "裸露", "色情", "胸部", "性器官"), "content.sexual", "CSA_002"),
    (("hate", "nazi", "symbol", "flag", "gesture", "仇恨", "极端", "符号", "旗帜", "手势"), "content.hate", "CSA_004"),
)
CONFLICTS = ("physical_conflict", "graphic_violence")
WEAPON = ("weapon", "gun", "knife", "pistol", "rifle", "枪", "刀", "武器")
WOUND = ("blood", "wound", "injured", "血迹", "伤口", "受伤")
PERSON = ("conflict", "participant", "person", "fight", "body", "contact", "冲突", "打斗", "人员", "身体", "接触", "推搡")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _first(text: Column, table: tuple, k: int, other: Column) -> Column:
    out = None
    for row in table:
        hit = has_any(text, row[0])
        out = F.when(hit, F.lit(row[k])) if out is None else out.when(hit, F.lit(row[k]))
    return out.otherwise(other)


def sureness(confidence: Column, review: Column) -> Column:
    """Confidence between 0 and 1; without one 0.7 for what asks for review, else 0."""
    return F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).when(F.coalesce(review, F.lit(False)), 0.7).otherwise(0.0)


def clip_risks(events: DataFrame, windows: DataFrame, least: float = LEAST) -> DataFrame:
    """asset_id, window_id, event_id, category, operator_id, confidence, start_ms, end_ms, review, conflict: risks of events that are unsafe and sure enough, or ask for review.

    events: the keys, category, label, activity, evidence, start_s, end_s, confidence, review; windows: asset_id, window_id,
    start_ms, end_ms. A span is cut to its window, and has a millisecond at least.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("category", "label", "activity", "evidence")]))
    calm, none = has_any(text, CALM), F.lit(None).cast("string")
    e = events.withColumns({"_c": F.when(~calm, _first(text, EVENTS, 1, none)), "_o": F.when(~calm, _first(text, EVENTS, 2, none)), "confidence": sureness(F.col("confidence"), F.col("review")), "review": F.coalesce("review", F.lit(False))})
    e = e.filter(F.col("_c").isNotNull() & ((F.col("confidence") >= least) | F.col("review")))
    w = windows.select("asset_id", "window_id", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_z"))
    e = e.join(w, ["asset_id", "window_id"])
    ms = lambda s, other: F.coalesce(F.bround(F.col(s) * 1000).cast("bigint"), F.col(other))
    a, z = ms("start_s", "_a"), ms("end_s", "_z")
    a, z = F.when(z <= a, F.col("_a")).otherwise(a), F.when(z <= a, F.col("_z")).otherwise(z)
    start = F.greatest(F.col("_a"), F.least(a, F.col("_z")))
    kind = F.lower(F.trim(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.col("label"), F.lit(""))))
    return e.select(*EVENT, F.col("_c").alias("category"), F.concat(F.lit("VVIS_"), "_o").alias("operator_id"), "confidence", start.alias("start_ms"), F.greatest(start + 1, F.least(z, F.col("_z"))).alias("end_ms"), "review", kind.isin(*CONFLICTS).alias("conflict"))


def event_frames(risks: DataFrame, members: DataFrame) -> DataFrame:
    """asset_id, window_id, event_id, frame_id: frames of the window that last into the event; all of the window's where none does. members: asset_id, window_id, frame_id, pts_ms, duration_ms."""
    j = risks.select(*EVENT, "start_ms", "end_ms").join(members, ["asset_id", "window_id"])
    j = j.withColumn("_in", (F.col("pts_ms") <= F.col("end_ms")) & (F.col("pts_ms") + F.greatest(F.lit(1), F.coalesce("duration_ms", F.lit(0))) >= F.col("start_ms")))
    some = j.groupBy(*EVENT).agg(F.bool_or("_in").alias("_some"))
    return j.join(some, EVENT).filter(F.col("_in") | ~F.col("_some")).select(*EVENT, "frame_id")


def conflict_regions(records: DataFrame, keyframes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and key frames of events of conflict, with all people and contacts of an event as one object (ord -1): in each frame, the box around their boxes.

    Weapons and wounds stay objects of their own. records: the keys, ord, words, box, confidence, review, start_s, end_s;
    keyframes: the keys, ord, frame_index, time_s, box, confidence. Boxes of the records themselves count where no key frame has one.
    """
    w = F.lower(F.coalesce("words", F.lit("")))
    person = ~has_any(w, WEAPON) & ~has_any(w, WOUND) & has_any(w, PERSON)
    r = records.withColumn("_p", person)
    people, rest = r.filter("_p").drop("_p"), r.filter("not _p").drop("_p")
    solid = lambda b: F.coalesce((b["w"] > 0) & (b["h"] > 0), F.lit(False))
    mine = people.select(*EVENT, "ord")
    k = keyframes.join(mine, [*EVENT, "ord"]).filter(solid(F.col("box")))
    place = F.coalesce(F.concat(F.lit("#"), F.col("frame_index").cast("string")), F.col("time_s").cast("string"), F.lit(""))
    none = F.lit(None)
    direct = people.filter(solid(F.col("box"))).join(k.select(*EVENT).distinct(), EVENT, "left_anti").select(*EVENT, "ord", none.cast("int").alias("frame_index"), none.cast("double").alias("time_s"), "box", sureness(F.col("confidence"), F.col("review")).alias("confidence"))
    every = k.select(*EVENT, "ord", "frame_index", "time_s", "box", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).unionByName(direct).withColumn("_k", place)
    b = F.col("box")
    union = every.groupBy(*EVENT, "_k").agg(F.first("frame_index").alias("frame_index"), F.first("time_s").alias("time_s"), F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x"] + b["w"]).alias("x1"), F.max(b["y"] + b["h"]).alias("y1"), F.max("confidence").alias("confidence"))
    union = union.select(*EVENT, F.lit(-1).alias("ord"), "frame_index", "time_s", g.box(F.col("x"), F.col("y"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y")).alias("box"), "confidence")
    one = people.join(union.select(*EVENT).distinct(), EVENT, "left_semi").groupBy(*EVENT).agg(F.bool_or(F.coalesce("review", F.lit(False))).alias("review"))
    one = one.select(*EVENT, F.lit(-1).alias("ord"), F.lit("conflict_region").alias("words"), none.cast(dict(records.dtypes)["box"]).alias("box"), none.cast("double").alias("confidence"), "review", none.cast("double").alias("start_s"), none.cast("double").alias("end_s"))
    gone = keyframes.join(mine, [*EVENT, "ord"], "left_anti").select(*EVENT, "ord", "frame_index", "time_s", "box", "confidence")
    return rest.select(*one.columns).unionByName(one), gone.unionByName(union)


def framed(keyframes: DataFrame, members: DataFrame) -> DataFrame:
    """Key frames with frame_id and pts_ms: by number, else nearest in time, else the first frame of the window. members: asset_id, window_id, frame_id, frame_index, pts_ms."""
    m = members.groupBy("asset_id", "window_id", "frame_index").agg(F.min(F.struct("pts_ms", "frame_id")).alias("f"))
    first = members.groupBy("asset_id", "window_id").agg(F.min(F.struct("pts_ms", "frame_id")).alias("first"))
    j = keyframes.join(m, ["asset_id", "window_id", "frame_index"], "left").join(first, ["asset_id", "window_id"])
    key = F.concat_ws("|", "asset_id", "window_id")
    at = F.bround(F.col("time_s") * 1000).cast("bigint")
    timed = j.filter("f is null and time_s is not null").select(key.alias("w"), at.alias("at_ms")).distinct().withColumn("point_id", F.col("at_ms"))
    near = video.nearest_frame(timed, members.select(key.alias("w"), "pts_ms"), "w").select("w", F.col("point_id").alias("_at"), F.col("nearest_ms").alias("_t"))
    by_time = members.groupBy(key.alias("w"), F.col("pts_ms").alias("_t")).agg(F.min("frame_id").alias("_id"))
    near = near.join(by_time, ["w", "_t"]).select("w", "_at", F.struct(F.col("_t").alias("pts_ms"), F.col("_id").alias("frame_id")).alias("n"))
    j = j.withColumn("w", key).withColumn("_at", F.when(F.col("f").isNull(), at)).join(near, ["w", "_at"], "left")
    own = F.coalesce("f", "n", "first")
    return j.select(*keyframes.columns, own["frame_id"].alias("frame_id"), own["pts_ms"].alias("pts_ms"))


def instances(risks: DataFrame, records: DataFrame, keyframes: DataFrame, members: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Objects of the risks of :func:`clip_risks`, and their regions.

    Objects: the keys, ord, category, operator_id, confidence, start_ms, end_ms, regions; regions: the keys, ord, frame_id, pts_ms,
    box, confidence. An object is sure enough, or asks for review; its span is cut to its event's.
    """
    steps = Steps(risks.sparkSession)  # risks and boxes are read by several steps each
    risks = steps.keep(risks)
    parent = risks.select(*EVENT, F.col("category").alias("_c"), F.col("operator_id").alias("_o"), F.col("confidence").alias("_s"), F.col("start_ms").alias("_a"), F.col("end_ms").alias("_z"), "conflict")
    fights = parent.filter("conflict").select(*EVENT)
    r, k = records.join(parent.select(*EVENT), EVENT, "left_semi"), keyframes.join(parent.select(*EVENT), EVENT, "left_semi")
    fr, fk = (steps.keep(t) for t in conflict_regions(r.join(fights, EVENT, "left_semi"), k.join(fights, EVENT, "left_semi")))
    r = steps.keep(r.join(fights, EVENT, "left_anti").select(*fr.columns).unionByName(fr))
    k = k.join(fights, EVENT, "left_anti").select(*fk.columns).unionByName(fk)
    none = F.lit(None)
    own = r.filter("box is not null").select(*EVENT, "ord", none.cast("int").alias("frame_index"), none.cast("double").alias("time_s"), "box", "confidence")
    boxes = k.join(r.select(*EVENT, "ord"), [*EVENT, "ord"], "left_semi").unionByName(own).filter((F.col("box.w") > 0) & (F.col("box.h") > 0))
    near = lambda b: F.struct(*[F.bround(b[n] * 1000).cast("bigint").alias(n) for n in "xywh"])
    boxes = steps.keep(boxes)
    placed = framed(boxes, members).groupBy(*EVENT, "ord", "frame_id", near(F.col("box")).alias("_k")).agg(F.min("pts_ms").alias("pts_ms"), F.first("box").alias("box"), F.max("confidence").alias("confidence"))
    placed = steps.keep(placed)
    count = placed.groupBy(*EVENT, "ord").agg(F.count("*").alias("regions"))
    j = r.join(count, [*EVENT, "ord"]).join(parent, EVENT)
    w, review = F.lower(F.coalesce("words", F.lit(""))), F.coalesce("review", F.lit(False))
    said = sureness(F.col("confidence"), review)
    sure = F.when(F.col("ord") == -1, F.col("_s")).when(said > 0, said).otherwise(F.col("_s"))
    ms = lambda s, other: F.coalesce(F.bround(F.col(s) * 1000).cast("bigint"), F.col(other))
    a, z = ms("start_s", "_a"), ms("end_s", "_z")
    out = j.select(
        *EVENT, "ord", _first(w, OBJECTS, 1, F.col("_c")).alias("category"), F.coalesce(F.concat(F.lit("VVIS_"), _first(w, OBJECTS, 2, none.cast("string"))), F.col("_o")).alias("operator_id"), sure.alias("confidence"),
        F.when(z <= a, F.col("_a")).otherwise(F.greatest("_a", a)).alias("start_ms"), F.when(z <= a, F.col("_z")).otherwise(F.least("_z", z)).alias("end_ms"), "regions", review.alias("review"),
    ).filter((F.col("confidence") >= least) | F.col("review"))
    out = steps.keep(out)
    steps.leave(out, placed)
    return out, placed.drop("_k").join(out.select(*EVENT, "ord"), [*EVENT, "ord"], "left_semi")
