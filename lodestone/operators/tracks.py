"""Tracks of objects over frames: one point a frame, series over all frames, redaction regions of every frame.

A track's points are chosen one after another, each by the last one chosen. Rows of a
track pass through a task in time order with only that last box for a state, so a long
track is never one row or one array; everything else is joins on keys and stretches of time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as g
from lodestone.operators import video

BOX = "struct<x:double,y:double,w:double,h:double>"


def seed_boxes(regions: DataFrame) -> DataFrame:
    """risk_id, box: the region of greatest confidence of each risk, the first of equals. regions: risk_id, ord, box, confidence."""
    return regions.filter("box is not null").groupBy("risk_id").agg(F.max_by("box", F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("ord"))).alias("box"))


def placed_points(points: DataFrame, frames: DataFrame) -> DataFrame:
    """risk_id, frame_id, pts_ms, ord, box, confidence: points at their frames, those without one at the frame nearest in time.

    points: risk_id, asset_id, ord, frame_id, pts_ms, box, confidence; frames: asset_id, frame_id, pts_ms. Points without a box, or of no frame, go.
    """
    p = points.filter("box is not null").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    f = frames.select("asset_id", "frame_id", F.col("pts_ms").alias("t"))
    named = p.filter("frame_id is not null").drop("pts_ms").join(f, ["asset_id", "frame_id"])
    loose = p.filter("frame_id is null and pts_ms is not null").drop("frame_id")
    times = loose.select("asset_id", F.col("pts_ms").cast("bigint").alias("at_ms")).distinct().withColumn("point_id", F.col("at_ms"))
    near = video.nearest_frame(times, frames).select("asset_id", F.col("point_id").alias("pts_ms"), F.col("nearest_ms").alias("t"))
    first = f.groupBy("asset_id", "t").agg(F.min("frame_id").alias("frame_id"))
    found = loose.join(near, ["asset_id", "pts_ms"]).drop("pts_ms").join(first, ["asset_id", "t"])
    pick = ["risk_id", "frame_id", F.col("t").alias("pts_ms"), "ord", "box", "confidence"]
    return named.select(*pick).unionByName(found.select(*pick))


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    whole = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / whole if whole > 0 else 0.0


def _sizes_alike(a: tuple, b: tuple) -> float:
    x, y = max(1.0, a[2] * a[3]), max(1.0, b[2] * b[3])
    return min(x, y) / max(x, y)


def _apart(a: tuple, b: tuple) -> float:
    return math.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)


def _reach(a: tuple) -> float:
    return 4 * math.hypot(a[2], a[3])


# Weights of overlap, closeness, likeness in size and confidence; the least score; what a step may be.
WEIGHTS = (0.45, 0.3, 0.15, 0.1)
LEAST, OVERLAP, SIZES, STEP = 0.08, 0.02, 0.18, 80.0


def best_point(last: tuple | None, candidates: list[tuple[tuple, float]]) -> int | None:
    """Which candidate (box, confidence) of a frame goes on from the last box, or None; the first of equals."""
    if last is None:
        return max(range(len(candidates)), key=lambda k: candidates[k][1])
    parts = [(_iou(last, b), max(0.0, 1 - _apart(last, b) / max(1.0, _reach(last))), _sizes_alike(last, b), c) for b, c in candidates]
    scores = [sum(x * w for x, w in zip(p, WEIGHTS)) for p in parts]
    at = max(range(len(scores)), key=scores.__getitem__)
    box = candidates[at][0]
    if scores[at] < LEAST:
        return None
    if _iou(last, box) < OVERLAP and (_sizes_alike(last, box) < SIZES or _apart(last, box) > max(STEP, _reach(last))):
        return None
    return at


def selected_points(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """The points of :func:`placed_points` that make each risk's track: at most one a frame, each chosen by the last.

    A seed (risk_id, box) is the first box; without one the first frame's surest point is. Frames whose best point does not go
    on from the last box give none, and the last box stays.
    """
    kind = dict(placed.dtypes)
    s = seeds.select("risk_id", F.col("box").alias("_seed"))
    rows = placed.join(s, "risk_id", "left").repartition(F.col("risk_id")).sortWithinPartitions("risk_id", "pts_ms", "frame_id", "ord")
    flat = rows.select("risk_id", "frame_id", "pts_ms", "ord", *[F.col(f"box.{c}").alias(c) for c in "xywh"], "confidence", F.col("_seed").isNotNull().alias("seeded"), *[F.col(f"_seed.{c}").alias(f"s{c}") for c in "xywh"])
    names = ["risk_id", "frame_id", "pts_ms", "ord", "x", "y", "w", "h", "confidence"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        risk, last, frame, held = object(), None, None, []

        def chosen() -> tuple | None:
            nonlocal last
            at = best_point(last, [(r[4:8], r[8]) for r in held])
            if at is None:
                return None
            last = held[at][4:8]
            return held[at]

        schema = None
        for b in batches:
            schema = pa.schema([b.schema.field(n) for n in names])
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and (r[0] != risk or r[1] != frame):
                    out.append(chosen())
                    held = []
                if r[0] != risk:
                    risk, last = r[0], r[10:14] if r[9] else None
                frame = r[1]
                held.append(r[:9])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out if x], f.type) for k, f in enumerate(schema)], schema=schema)
        if held:
            x = chosen()
            yield pa.RecordBatch.from_arrays([pa.array([x[k]] if x else [], f.type) for k, f in enumerate(schema)], schema=schema)

    ddl = f"risk_id {kind['risk_id']}, frame_id {kind['frame_id']}, pts_ms {kind['pts_ms']}, ord {kind['ord']}, x double, y double, w double, h double, confidence double"
    out = flat.mapInArrow(kernel, ddl)
    return out.select("risk_id", "frame_id", "pts_ms", "ord", g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), "confidence")


def track_flags(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """risk_id, points, selected, flags: ambiguous where a frame has several points, unstable where a frame with points has none selected."""
    per = placed.groupBy("risk_id", "frame_id").agg(F.count("*").alias("n")).groupBy("risk_id").agg(F.sum("n").alias("points"), F.count("*").alias("frames"), F.max("n").alias("most"))
    got = chosen.groupBy("risk_id").agg(F.count("*").alias("selected"))
    j = per.join(got, "risk_id", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    flags = F.concat_ws(",", F.when(F.col("most") > 1, "ambiguous_points_same_frame"), F.when(F.col("selected") < F.col("frames"), "unstable_track"))
    return j.select("risk_id", "points", "selected", flags.alias("flags"))


def new_regions(chosen: DataFrame, regions: DataFrame) -> DataFrame:
    """Chosen points that are not yet regions of their risk: same frame, and same box to a thousandth."""
    key = lambda b: F.struct(*[F.bround(b[n] * 1000).cast("bigint").alias(n) for n in "xywh"])
    have = regions.filter("box is not null").select("risk_id", "frame_id", key(F.col("box")).alias("_k")).distinct()
    return chosen.withColumn("_k", key(F.col("box"))).join(have, ["risk_id", "frame_id", "_k"], "left_anti").dropDuplicates(["risk_id", "frame_id", "_k"]).drop("_k")


def full_series(keys: DataFrame, frames: DataFrame, most: int = 1000) -> DataFrame:
    """track_id, frame_id, pts_ms, box, confidence, source: each track's key boxes and, on frames between two that are at most ``most`` ms apart, boxes in between.

    keys: track_id, asset_id, frame_id, pts_ms, box, confidence; frames: asset_id, frame_id, pts_ms. A range join in stretches of
    ``most`` ms: an interval between keys lies in two of them at most, so neither side meets all of the other.
    """
    w = Window.partitionBy("track_id").orderBy("pts_ms", "frame_id")
    k = keys.withColumns({"_t": F.lead("pts_ms").over(w), "_b": F.lead("box").over(w), "_c": F.lead("confidence").over(w)})
    gap = k.filter((F.col("_t") > F.col("pts_ms")) & (F.col("_t") - F.col("pts_ms") <= most)).withColumn("_s", F.explode(F.sequence(F.floor(F.col("pts_ms") / most), F.floor(F.col("_t") / most))))
    f = frames.select("asset_id", F.col("frame_id").alias("_f"), F.col("pts_ms").alias("at"), F.floor(F.col("pts_ms") / most).alias("_s"))
    j = gap.join(f, ["asset_id", "_s"]).filter((F.col("at") > F.col("pts_ms")) & (F.col("at") < F.col("_t")))
    share = (F.col("at") - F.col("pts_ms")) / (F.col("_t") - F.col("pts_ms"))
    between = j.select("track_id", F.col("_f").alias("frame_id"), F.col("at").alias("pts_ms"), g.between(F.col("box"), F.col("_b"), share).alias("box"), F.least("confidence", "_c").alias("confidence"), F.lit("interpolated").alias("source"))
    return keys.select("track_id", "frame_id", "pts_ms", "box", "confidence", F.lit("detected").alias("source")).unionByName(between)


def grown(b: Column, width: Column, height: Column) -> Column:
    """A box in pixels (it may be in shares of the picture) with 8 % more on each side, two pixels at least, cut at the picture's edges; null if nothing is left."""

    def scaled(b: Column) -> Column:
        part = F.greatest(*[F.abs(b[n]) for n in "xywh"]) <= 1.5
        return F.when(part, g.box(b["x"] * width, b["y"] * height, b["w"] * width, b["h"] * height)).otherwise(b)

    def padded(b: Column) -> Column:
        px, py = F.greatest(F.lit(2.0), b["w"] * 0.08), F.greatest(F.lit(2.0), b["h"] * 0.08)
        x0, y0 = F.greatest(F.lit(0.0), b["x"] - px), F.greatest(F.lit(0.0), b["y"] - py)
        return g.box(x0, y0, F.least(width, b["x"] + b["w"] + px) - x0, F.least(height, b["y"] + b["h"] + py) - y0)

    return g.once(g.once(g.once(b, scaled), padded), lambda b: F.when((b["w"] > 1) & (b["h"] > 1), b))


# Operations that keep their names as redaction modes; all others are black boxes.
MODES = ("gaussian_blur", "pixelate", "solid_fill")


def redaction_points(operations: DataFrame, series: DataFrame, regions: DataFrame, frames: DataFrame, stretch: int = 10_000) -> DataFrame:
    """operation_id, frame_id, pts_ms, mode, box, confidence, source: what is to be covered in every frame.

    operations: operation_id, asset_id, operation, modality; series and regions: operation_id, frame_id, pts_ms, box,
    confidence, source; frames: asset_id, frame_id, pts_ms, duration_ms, width, height. A point of a series belongs to its
    frame, or without one to the frame that lasts over its time; an operation without a series takes its regions.
    Audio is not covered.
    """
    name = F.lower(F.trim(F.coalesce("operation", F.lit(""))))
    ops = operations.filter((F.coalesce("modality", F.lit("")) != "audio") & (name != "mute")).select("operation_id", "asset_id", F.when(name.isin(*MODES), name).otherwise("black_box").alias("mode"))
    f = frames.filter("width > 0 and height > 0").select("asset_id", F.col("frame_id").alias("_f"), F.col("pts_ms").alias("_t"), (F.col("pts_ms") + F.greatest(F.lit(1), F.coalesce("duration_ms", F.lit(1)))).alias("_e"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    s = series.join(ops, "operation_id")
    named = s.filter("frame_id is not null").withColumn("_f", F.col("frame_id")).join(f, ["asset_id", "_f"])
    over = f.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_t") / stretch), F.floor((F.col("_e") - 1) / stretch))))
    timed = s.filter("frame_id is null and pts_ms is not null").withColumn("_s", F.floor(F.col("pts_ms") / stretch)).join(over, ["asset_id", "_s"]).filter((F.col("pts_ms") >= F.col("_t")) & (F.col("pts_ms") < F.col("_e")))
    bare = regions.join(series.select("operation_id").distinct(), "operation_id", "left_anti").join(ops, "operation_id").withColumn("_f", F.col("frame_id")).withColumn("source", F.lit("operation_region")).join(f, ["asset_id", "_f"])
    pick = ["operation_id", F.col("_f").alias("frame_id"), F.coalesce("pts_ms", "_t").alias("pts_ms"), "mode", "box", "width", "height", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("source", F.lit("track_redaction")).alias("source")]
    every = named.select(*pick).unionByName(timed.select(*pick)).unionByName(bare.select(*pick))
    return every.withColumn("box", grown(F.col("box"), F.col("width"), F.col("height"))).drop("width", "height").filter("box is not null")
