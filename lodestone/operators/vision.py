"""What follows vision models: box dedup, identifiable faces, candidate quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry as g

BOX = "struct<x:double,y:double,w:double,h:double>"


def box_dedup(findings: DataFrame, image: str = "image_id", least: float = 0.82, inside: float = 0.85) -> DataFrame:
    """Boxes that stay, best score first: one that nearly equals a kept one of its kind, or is one inside the other at twice the size, goes.

    Of faces inside each other the smaller one takes the kept one's place if its score is at least 0.7 of that.
    Findings without a box stay.
    """
    item = F.struct((-F.col("score")).alias("s"), "id", "category", "finding_type", "box")
    per = findings.groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("x"))
    init = F.array().cast(f"array<struct<s:double,id:bigint,category:string,finding_type:string,box:{BOX}>>")

    def step(kept: Column, f: Column) -> Column:
        held = lambda k: g.containment(k["box"], f["box"]) >= inside
        twice = lambda k: F.greatest(g.area(k["box"]), g.area(f["box"])) >= 2 * F.least(g.area(k["box"]), g.area(f["box"]))
        same = lambda k: (k["category"] == f["category"]) & (k["finding_type"] == f["finding_type"]) & ((g.iou(k["box"], f["box"]) >= least) | (held(k) & twice(k)))
        at = F.array_min(F.array_compact(F.transform(kept, lambda k, i: F.when(same(k), i))))
        old = F.get(kept, at)
        # scores only fall, so nothing but a smaller face is preferred
        better = (f["category"] == "face") & held(old) & (g.area(f["box"]) < g.area(old["box"])) & (-f["s"] >= -old["s"] * 0.7)
        return F.when(at.isNull(), F.concat(kept, F.array(f))).when(better, F.transform(kept, lambda k, i: F.when(i == at, f).otherwise(k))).otherwise(kept)

    return per.select(image, F.explode(F.aggregate("x", init, step)).alias("f")).select(image, "f.id", "f.category", (-F.col("f.s")).alias("score"), "f.box")


def clipped(b: Column, width: Column, height: Column) -> Column:
    """A box at the image's edge that is too small there to tell a face."""
    mx, my = F.greatest(F.lit(2.0), b["w"] * 0.08), F.greatest(F.lit(2.0), b["h"] * 0.08)
    x = (b["x"] <= mx) | (b["x"] + b["w"] >= width - mx)
    y = (b["y"] <= my) | (b["y"] + b["h"] >= height - my)
    return (x & (b["w"] < 48)) | (y & (b["h"] < 48))


def visible_points(points: Column, b: Column) -> Column:
    """Key points (array<struct<x, y>>) in the box or near it."""
    px, py = F.greatest(F.lit(4.0), b["w"] * 0.2), F.greatest(F.lit(4.0), b["h"] * 0.2)
    inside = lambda p: p["x"].between(b["x"] - px, b["x"] + b["w"] + px) & p["y"].between(b["y"] - py, b["y"] + b["h"] + py)
    return F.size(F.filter(points, inside))


def identifiability(faces: DataFrame) -> DataFrame:
    """reasons (comma-joined), identifiable, confidence of faces: box, score, points, width, height; any failed test weakens the score."""
    b = F.col("box")
    short, long = F.least(b["w"], b["h"]), F.greatest(b["w"], b["h"])
    ratio = b["w"] / F.greatest(F.lit(1.0), b["h"])
    share = g.area(b) / F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    tests = {
        "small": short < 24, "tiny_share": share < 0.0003, "aspect": (ratio < 0.55) | (ratio > 1.8), "narrow": short / F.greatest(F.lit(1.0), long) < 0.42,
        "clipped": clipped(b, F.col("width"), F.col("height")), "few_points": visible_points(F.col("points"), b) < 3, "low_score": F.col("score") < 0.45,
    }
    out = faces.withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()])), ","))
    out = out.withColumn("identifiable", F.col("reasons") == "")
    return out.withColumn("confidence", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.col("score")) * F.when(F.col("identifiable"), 1.0).otherwise(0.45)), 4))


def is_placeholder(text: Column) -> Column:
    """Recognised text that is only an image mark."""
    return F.length(F.regexp_replace(text, r"!?\[[^\]]*\]\([^)]*\)|<img[^>]*>|\s", "")) == 0


def text_blocks(blocks: DataFrame, image: str = "image_id") -> DataFrame:
    """First of blocks whose first 80 characters and rounded boxes agree; placeholders go."""
    b = F.col("box")
    key = [image, F.substring("text", 1, 80).alias("k"), *[F.round(b[n]).cast("bigint").alias(f"_{n}") for n in "xywh"]]
    kept = blocks.filter(~is_placeholder(F.col("text"))).groupBy(*key).agg(F.min_by(F.struct("block_id", "text"), "block_id").alias("v"))
    return kept.select(image, "v.block_id", "v.text")
