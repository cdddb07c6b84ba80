"""Frame timelines: scenes, clips, segments, nearest frames, interpolation, caches, risks, review and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as g
from lodestone.ranks import SEVERITY, code, lookup, rank


def scene_boundaries(frames: DataFrame, asset: str = "asset_id", least: float = 0.18, gap: int = 1000) -> DataFrame:
    """Times at which a scene begins: difference to the previous frame at least ``least`` and ``gap`` ms since the last boundary.

    frames: asset, pts_ms, value. The rule refers to its own last result, so an asset's frames are folded.
    """
    per = frames.groupBy(asset).agg(F.array_sort(F.collect_list(F.struct("pts_ms", "value"))).alias("f"))
    init = F.struct(F.lit(None).cast("double").alias("v"), F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        cut = acc["last"].isNull() | ((F.abs(f["value"] - acc["v"]) >= least) & (f["pts_ms"] - acc["last"] >= gap))
        return F.struct(f["value"].alias("v"), F.when(cut, f["pts_ms"]).otherwise(acc["last"]).alias("last"), F.when(cut, F.concat(acc["out"], F.array(f["pts_ms"]))).otherwise(acc["out"]).alias("out"))

    return per.select(asset, F.posexplode(F.aggregate("f", init, step, lambda a: a["out"])).alias("scene", "start_ms"))


def clip_windows(scenes: DataFrame, size: int = 5000, step: int = 4000) -> DataFrame:
    """Sliding windows of each scene, clipped to it; none begins once one has reached the end."""
    last = F.greatest(F.lit(0), F.ceil((F.col("end_ms") - F.col("start_ms") - size) / step)).cast("bigint")
    k = scenes.withColumn("clip", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return k.withColumn("clip_start", F.col("start_ms") + F.col("clip") * step).withColumn("clip_end", F.least(F.col("start_ms") + F.col("clip") * step + size, F.col("end_ms")))


def clip_members(clips: DataFrame, frames: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Frames of each clip: a range join within an asset."""
    f = frames.select(F.col(asset).alias("_a"), "frame_id", "pts_ms")
    return clips.join(f, (F.col("_a") == F.col(asset)) & (F.col("pts_ms") >= F.col("clip_start")) & (F.col("pts_ms") < F.col("clip_end"))).drop("_a")


def evenly(frames: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """At most ``most`` frames of each group, evenly spaced, first and last included."""
    w = Window.partitionBy(by)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(max(most - 1, 1))))
    return frames.withColumn("_n", n).withColumn("_i", i).filter((F.col("_n") <= most) | F.array_contains(picks, F.col("_i").cast("double"))).drop("_n", "_i")


def segments(frames: DataFrame, asset: str = "asset_id", route: str = "route", order: str = "pts_ms", tie: str = "frame_id") -> DataFrame:
    """Runs of equal routes: gaps and islands."""
    w = Window.partitionBy(asset).orderBy(order, tie)
    new = F.when(F.lag(route).over(w).eqNullSafe(F.col(route)), 0).otherwise(1)
    runs = frames.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w))
    return runs.groupBy(asset, "segment").agg(F.first(route).alias(route), F.min(order).alias("start_ms"), F.max(order).alias("end_ms"), F.count("*").alias("frames"))


def nearest_frame(points: DataFrame, frames: DataFrame, asset: str = "asset_id", bucket: int = 3_600_000) -> DataFrame:
    """The frame nearest in time to each point (asset, point_id, at_ms); the earlier of equals.

    An as-of join both ways: points and frames are merged in time order within stretches of ``bucket`` ms, and the last
    frame before and the first one after are carried to each point by running windows. What comes before or after a
    stretch is one row a stretch, so a long asset is not one task and no pairs are made.
    """
    none = F.lit(None).cast("bigint")
    p = points.select(asset, F.col("at_ms").alias("t"), F.lit(1).alias("kind"), "point_id", none.alias("ft"))
    f = frames.select(asset, F.col("pts_ms").alias("t"), F.lit(0).alias("kind"), none.alias("point_id"), F.col("pts_ms").alias("ft"))
    both = p.unionByName(f).withColumn("stretch", F.floor(F.col("t") / bucket))
    edges = both.groupBy(asset, "stretch").agg(F.min("ft").alias("lo"), F.max("ft").alias("hi"))
    w = Window.partitionBy(asset)
    edges = edges.select(asset, "stretch", F.last("hi", True).over(w.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.last("lo", True).over(w.orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("lo"))
    w = Window.partitionBy(asset, "stretch")
    up = F.last("ft", True).over(w.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    down = F.last("ft", True).over(w.orderBy(F.col("t").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0))
    j = both.withColumn("up", up).withColumn("down", down).filter("kind = 1").join(edges, [asset, "stretch"])
    before, after = F.coalesce("up", "hi"), F.coalesce("down", "lo")
    return j.select(asset, "point_id", F.when(before.isNotNull() & (after.isNull() | (F.col("t") - before <= after - F.col("t"))), before).otherwise(after).alias("nearest_ms"))


def interpolated(keys: DataFrame, frames: DataFrame, track: str = "track_id", most: int = 4000) -> DataFrame:
    """Boxes at frames between two key boxes of a track that are at most ``most`` ms apart."""
    w = Window.partitionBy(track).orderBy("pts_ms")
    k = keys.withColumn("_t", F.lead("pts_ms").over(w)).withColumn("_b", F.lead("box").over(w)).filter((F.col("_t") - F.col("pts_ms") <= most) & (F.col("_t") > F.col("pts_ms")))
    f = frames.select(F.col(track).alias("_k"), "frame_id", F.col("pts_ms").alias("at"))
    j = k.join(f, (F.col("_k") == F.col(track)) & (F.col("at") > F.col("pts_ms")) & (F.col("at") < F.col("_t")))
    share = (F.col("at") - F.col("pts_ms")) / (F.col("_t") - F.col("pts_ms"))
    return j.select(track, "frame_id", F.col("at").alias("pts_ms"), g.between(F.col("box"), F.col("_b"), share).alias("box"))


def cached(frames: DataFrame, asset: str = "asset_id", content: str = "hash") -> DataFrame:
    """Each frame with the first frame of equal content, whose result it takes."""
    first = frames.groupBy(asset, content).agg(F.min_by("frame_id", F.struct("pts_ms", "frame_id")).alias("source_frame"))
    return frames.join(first, [asset, content]).select(asset, "frame_id", "source_frame", (F.col("frame_id") != F.col("source_frame")).alias("cached"))


def risk_windows(risks: DataFrame, gap: int = 1000, by: tuple[str, ...] = ("asset_id", "category")) -> DataFrame:
    """Risks without boxes, merged where they lie at most ``gap`` ms apart: start, end, highest severity, greatest confidence."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms", "risk_id")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_ms") > before + gap), 1).otherwise(0)
    i = risks.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    top = code(F.max(rank(F.col("severity"), SEVERITY)), SEVERITY)
    return i.groupBy(*by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), top.alias("severity"), F.max("confidence").alias("confidence"), F.count("*").alias("risks"))


# Modalities that are judged by their boxes, those of events without a place, and those of objects.
VISUAL = ("visual", "picture", "safety", "visual_safety", "video_clip")
EVENTS = ("safety", "visual_safety", "video_clip")
OBJECTS = ("visual", "ocr_text", "video_object")


def same_place(a: Column, b: Column, least: float) -> Column:
    """Whether a risk at box b goes on from one at box a: by overlap, or as one object that has moved; without boxes, as one event."""
    both, none = a["box"].isNotNull() & b["box"].isNotNull(), a["box"].isNull() & b["box"].isNull()
    thing = lambda r: r["box"].isNotNull() & (r["category"].startswith("privacy.") | r["modality"].isin(*OBJECTS))
    small, large = F.least(g.area(a["box"]), g.area(b["box"])), F.greatest(g.area(a["box"]), g.area(b["box"]))
    reach = F.greatest(F.lit(120.0), 3 * F.sqrt(a["box"]["w"] * a["box"]["w"] + a["box"]["h"] * a["box"]["h"]))
    moved = thing(a) & (a["category"] != "privacy.face") & (a["modality"] != "ocr_text") & (F.greatest(small, F.lit(1.0)) >= 0.2 * F.greatest(large, F.lit(1.0))) & (g.centre_distance(a["box"], b["box"]) <= reach)
    event = a["category"].startswith("content.") & a["modality"].isin(*EVENTS)
    near = both & (g.iou(a["box"], b["box"]) >= least)
    seen = F.when(thing(a) != thing(b), False).when(both, near | moved).otherwise(none & event)
    return F.coalesce(F.when(a["modality"].isin(*VISUAL), seen).otherwise((thing(a) == thing(b)) & (~both | near)), F.lit(False))


def temporal_merge(risks: DataFrame, gap: int = 1000, least: float = 0.35) -> DataFrame:
    """Greedy merge of risks of an asset, category, modality and text, in time order: a risk joins the latest merged one that is near in time and in the same place as its last part.

    asset_id, category, modality, risk_id (of the first part), start_ms, end_ms, severity, confidence, parts. Risks further
    apart than ``gap`` cannot merge, so only those between such gaps are folded together.
    """
    by = ["asset_id", "category", "modality", "text_span"]
    w = Window.partitionBy(*by).orderBy("start_ms", "risk_id")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = risks.withColumn("_new", F.when(before.isNull() | (F.col("start_ms") > before + gap), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    item = F.struct("start_ms", "risk_id", "end_ms", rank(F.col("severity"), SEVERITY).alias("s"), "confidence", "box", "category", "modality")
    per = cut.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(item)).alias("r"))
    kind = "array<struct<start_ms:bigint,risk_id:bigint,end_ms:bigint,s:int,confidence:double,box:struct<x:double,y:double,w:double,h:double>,category:string,modality:string,parts:int>>"

    def step(out: Column, r: Column) -> Column:
        fits = F.transform(out, lambda o, i: F.when((r["start_ms"] - o["end_ms"] <= gap) & same_place(o, r, least), i))
        at = F.array_max(F.array_compact(fits))
        same = lambda o, end, s, c, box, n: F.struct(o["start_ms"].alias("start_ms"), o["risk_id"].alias("risk_id"), end.alias("end_ms"), s.alias("s"), c.alias("confidence"), box.alias("box"), o["category"].alias("category"), o["modality"].alias("modality"), n.alias("parts"))
        join = lambda o, i: F.when(i == at, same(o, F.greatest(o["end_ms"], r["end_ms"]), F.greatest(o["s"], r["s"]), F.greatest(o["confidence"], r["confidence"]), F.coalesce(r["box"], o["box"]), o["parts"] + 1)).otherwise(o)
        return F.when(at.isNull(), F.concat(out, F.array(same(r, r["end_ms"], r["s"], r["confidence"], r["box"], F.lit(1))))).otherwise(F.transform(out, join))

    m = per.select("asset_id", F.explode(F.aggregate("r", F.array().cast(kind), step)).alias("m"))
    return m.select("asset_id", "m.category", "m.modality", "m.risk_id", "m.start_ms", "m.end_ms", code(F.col("m.s"), SEVERITY).alias("severity"), "m.confidence", "m.parts")


def main_route(frames: DataFrame, asset: str = "asset_id", route: str = "route") -> DataFrame:
    """Most common route of an asset; of equals the one seen first."""
    c = frames.groupBy(asset, route).agg(F.count("*").alias("n"), F.min("pts_ms").alias("first"))
    return c.groupBy(asset).agg(F.max_by(route, F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias("route"))


# Order of decisions, and categories hidden by a box.
DECISIONS = ["allow", "allow_with_risk_labels", "transform_required", "review_required", "restricted", "reject"]
BOXED = ("privacy.qr_code", "privacy.barcode", "privacy.id_card", "privacy.phone", "privacy.address", "privacy.screen_sensitive")


def governance(risks: DataFrame, asset: str = "asset_id") -> DataFrame:
    """asset, decision, requires_review, requires_transformation, risks, reasons of assets with risks (risk_id gives their order; excluded, eligible).

    A minor-related risk rejects, and takes back the transformation that earlier ones asked for; other content asks for
    review; private data that can be hidden for transformation; the rest is allowed with labels.
    """
    c, on = F.col("category"), ~F.col("excluded")
    minor, content, private = on & (c == "content.sexual_minor"), on & c.startswith("content."), on & c.startswith("privacy.") & F.col("eligible")
    name = F.upper(F.regexp_replace(c, "[.-]", "_"))
    reason = F.when(minor, F.concat(F.lit("REJECT_ENABLED_OPERATOR_"), name)).when(content, F.concat(F.lit("REVIEW_ENABLED_OPERATOR_"), name)).when(private, F.concat(F.lit("PLAN_REDACTION_FOR_ENABLED_OPERATOR_"), name))
    a = risks.groupBy(asset).agg(
        F.max(F.when(minor, 5).when(content, 3).when(private, 2).otherwise(1)).alias("r"), F.bool_or(content).alias("requires_review"),
        F.max(F.when(private, F.col("risk_id"))).alias("p"), F.max(F.when(minor, F.col("risk_id"))).alias("m"), F.count("*").alias("risks"),
        F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"),
    )
    again = F.coalesce(F.col("p").isNotNull() & (F.col("m").isNull() | (F.col("p") > F.col("m"))), F.lit(False))
    return a.select(asset, code(F.col("r"), DECISIONS).alias("decision"), "requires_review", again.alias("requires_transformation"), "risks", "reasons")


def action_plan(risks: DataFrame) -> DataFrame:
    """operation of each risk that is hidden without a person's help: private data that is eligible, and located unless it is sound."""
    c = F.col("category")
    op = F.when(c == "privacy.face", "gaussian_blur").when(c.isin(*BOXED), "black_box").when(F.col("modality") == "audio", "mute").otherwise("black_box")
    ok = ~F.col("excluded") & F.col("eligible") & c.startswith("privacy.") & ((F.col("modality") == "audio") | F.col("box").isNotNull())
    return risks.filter(ok).withColumn("operation", op)


def review_queue(risks: DataFrame, low: float = 0.65) -> DataFrame:
    """Risks for a person to look at: priority (high or medium) and reasons."""
    grave, unsure, lost, clip = F.col("severity").isin("critical", "high"), F.col("confidence") < low, F.col("box").isNull() & (F.col("modality") != "audio"), F.col("modality") == "video_clip"
    priority = F.when(grave, "high").when(unsure | lost | clip, "medium")
    hidden = F.col("category").startswith("privacy.") & lost
    reason = F.array_compact(F.array(F.when(grave, "high_severity"), F.when(unsure, "low_confidence"), F.when(lost, "unlocated"), F.when(hidden, "not_redactable"), F.when(clip, "clip_behaviour")))
    return risks.withColumn("priority", priority).filter("priority is not null").withColumn("reasons", F.array_join(reason, ","))


def review_items(risks: DataFrame, policy: DataFrame, plan: DataFrame, asset: str = "asset_id") -> DataFrame:
    """review_id, asset, priority, review_type of everything a person looks at: decisions, risks, and operations without a region."""
    return (
        policy.filter("requires_review").select(F.concat(F.lit("policy_review_"), F.col(asset).cast("string")).alias("review_id"), asset, F.lit("high").alias("priority"), F.lit("policy_decision").alias("review_type"))
        .unionByName(review_queue(risks).select(F.concat(F.lit("review_"), F.col("risk_id").cast("string")).alias("review_id"), asset, "priority", F.lit("risk_annotation").alias("review_type")))
        .unionByName(plan.filter(F.col("box").isNull() & (F.col("modality") != "audio")).select(F.concat(F.lit("operation_region_"), F.col("risk_id").cast("string")).alias("review_id"), asset, F.lit("medium").alias("priority"), F.lit("redaction_region_missing").alias("review_type")))
    )


def quality_report(risks: DataFrame, asset: str = "asset_id") -> DataFrame:
    return risks.groupBy(asset).agg(F.count("*").alias("risks"), F.count_if(F.col("box").isNull()).alias("unlocated"), F.count_if(F.col("confidence") < 0.65).alias("low_confidence"), F.countDistinct("category").alias("categories"))


def frame_results(frames: DataFrame, results: DataFrame, asset: str = "asset_id") -> DataFrame:
    """asset, frame_id, result: a frame's own, else that of the frame it was cached from (source_frame), else the last one before; without any the frame goes."""
    own = results.select(F.col("frame_id").alias("_f"), F.col("result").alias("_own"))
    src = results.select(F.col("frame_id").alias("_s"), F.col("result").alias("_src"))
    j = frames.join(own, F.col("frame_id") == F.col("_f"), "left").join(src, F.col("source_frame") == F.col("_s"), "left").withColumn("_r", F.coalesce("_own", "_src"))
    w = Window.partitionBy(asset).orderBy("pts_ms", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("result", F.last("_r", True).over(w)).filter("result is not null").select(asset, "frame_id", "result")


def aggregate_policy(frames: DataFrame, audio: DataFrame, asset: str = "asset_id") -> DataFrame:
    """asset, decision of frames' decisions (pass_raw, pass_redacted, drop) and the audio decision: the gravest, where quarantined sound drops and doubtful sound is redacted."""
    order = ["pass_raw", "pass_redacted", "drop"]
    f = frames.groupBy(asset).agg(F.max(rank(F.col("decision"), order)).alias("f"))
    a = audio.select(asset, F.when(F.col("audio").isin("reject", "quarantine"), 2).when(F.col("audio") == "review", 1).otherwise(0).alias("a"))
    return f.join(a, asset, "left").select(asset, code(F.greatest("f", F.coalesce("a", F.lit(0))), order).alias("decision"))


# Categories of findings of pictures, and severities by category.
FOUND = {
    "face": "privacy.face", "id_card": "privacy.id_card", "badge": "privacy.badge", "signature": "privacy.signature", "stamp": "privacy.stamp", "qr_code": "privacy.qr_code", "barcode": "privacy.barcode",
    "license_plate": "privacy.license_plate", "avatar": "privacy.face", "account_region": "privacy.account_region", "school_class_identifier": "privacy.school_class_identifier", "phone": "privacy.phone",
    "phone_number": "privacy.phone", "address": "privacy.address", "screen_sensitive": "privacy.screen_sensitive",
}
CRITICAL, GRAVE, PLAIN = ("content.sexual_minor", "content.graphic_violence"), ("privacy.id_card", "privacy.phone", "privacy.address"), ("privacy.face", "privacy.license_plate", "privacy.qr_code")


def category_of(category: Column, reason: Column) -> Column:
    """Category of a picture's finding: by its name, else by words of its reason, else as a visual of that name."""
    c, r = F.lower(F.trim(category)), F.lower(F.trim(reason))
    words = [("sexual|porn", "content.sexual"), ("violence|violent", "content.violence"), ("hate", "content.hate"), ("self_harm|suicide", "content.self_harm"), ("phone", "privacy.phone"), ("address", "privacy.address")]
    out = lookup(c, FOUND)
    said = F.concat(F.lit("visual."), F.when(c == "", "unknown").otherwise(c))
    for rx, name in reversed(words):
        said = F.when(r.rlike(rx), name).otherwise(said)
    return F.coalesce(out, said)


def severity_of(category: Column, confidence: Column, review: Column) -> Column:
    sure = F.when(confidence >= 0.7, "high").otherwise("medium")
    return F.when(category.isin(*CRITICAL), "critical").when(category.startswith("content.") | category.isin(*GRAVE), sure).when(category.isin(*PLAIN), F.when(confidence >= 0.5, "medium").otherwise("low")).when(review, "medium").otherwise("low")


def allowed_by_selection(risks: DataFrame, disabled_operators: list[str], disabled_targets: list[str]) -> DataFrame:
    """Risks of whose operators (operator_id, source_operator_id) none is disabled, nor their target or category."""
    ops = F.array(F.upper(F.trim("operator_id")), F.upper(F.trim("source_operator_id")))
    goals = F.array(F.lower(F.trim("target_type")), F.lower(F.trim("category")))
    named = lambda xs, f: F.array(*[F.lit(f(x.strip())) for x in xs]).cast("array<string>")
    return risks.filter(~F.arrays_overlap(ops, named(disabled_operators, str.upper)) & ~F.arrays_overlap(goals, named(disabled_targets, str.lower)))


def unstable_tracks(series: DataFrame, track: str = "track_id") -> DataFrame:
    """track, unstable: whether any two boxes in a row barely overlap and differ much in size, or lie far apart."""
    w = Window.partitionBy(track).orderBy("pts_ms", "frame_id")
    a, b = F.col("_a"), F.col("box")
    size = F.least(F.greatest(g.area(a), F.lit(1.0)), F.greatest(g.area(b), F.lit(1.0))) / F.greatest(F.greatest(g.area(a), F.lit(1.0)), F.greatest(g.area(b), F.lit(1.0)))
    jump = a.isNotNull() & b.isNotNull() & (g.iou(a, b) < 0.02) & ((size < 0.18) | (g.centre_distance(a, b) > F.greatest(F.lit(80.0), 4 * F.sqrt(a["w"] * a["w"] + a["h"] * a["h"]))))
    return series.withColumn("_a", F.lag("box").over(w)).groupBy(track).agg(F.coalesce(F.bool_or(jump), F.lit(False)).alias("unstable"))


def supported_events(events: DataFrame, risks: DataFrame, tolerance: int = 250, asset: str = "asset_id") -> DataFrame:
    """asset, event_id, supports: how many risks lie within ``tolerance`` ms of an event and name it as parent, or are objects or safety findings of its category."""
    r = risks.select(F.col(asset).alias("_a"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("category").alias("_c"), "modality", "parent_id")
    near = (F.col("_a") == F.col(asset)) & (F.col("_s") <= F.col("end_ms") + tolerance) & (F.col("start_ms") <= F.col("_e") + tolerance)
    fits = F.coalesce(F.col("parent_id") == F.col("event_id"), F.lit(False)) | (F.col("modality").isin("video_object", "safety", "visual_safety") & (F.col("_c") == F.col("category")))
    return events.join(r, near & fits, "left").groupBy(asset, "event_id").agg(F.count("_s").alias("supports"))


def display_order(risks: DataFrame, asset: str = "asset_id") -> DataFrame:
    """asset, place, risk_id: each risk once, by start, role and id."""
    role = lookup(F.col("role"), {"primary_event": 0, "primary_privacy": 1, "primary_object": 2}, 3)
    first = risks.groupBy(asset, "risk_id").agg(F.min(F.struct("start_ms", role.alias("k"))).alias("o"))
    return first.select(asset, "risk_id", (F.row_number().over(Window.partitionBy(asset).orderBy("o", "risk_id")) - 1).alias("place"))


def hash_distance(a: Column, b: Column) -> Column:
    """Share of the 64 bits in which two average hashes differ."""
    return F.bit_count(a.bitwiseXOR(b)) / 64.0


def distinct_regions(regions: Column) -> Column:
    """The first of regions (struct<frame_id, box>) that agree in frame and in box to a thousandth."""
    key = lambda r: F.struct(r["frame_id"], *[F.round(r["box"][n] * 1000).cast("bigint") for n in "xywh"])
    return F.filter(regions, lambda r, i: F.array_position(F.transform(regions, key), key(r)) == i + 1)
