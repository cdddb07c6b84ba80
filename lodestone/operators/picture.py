"""Picture findings: merges, redaction plans, policy, and text of OCR blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as g
from lodestone.ranks import lookup

# Category -> (mode, part of the box that is hidden: left, top, width, height).
CORE = {
    "face": ("gaussian_blur", 0.18, 0.22, 0.64, 0.38), "license_plate": ("black_box", 0.12, 0.22, 0.76, 0.56), "badge": ("pixelate", 0.08, 0.25, 0.84, 0.55),
    "id_card": ("black_box", 0.08, 0.28, 0.84, 0.48), "student_id_card": ("black_box", 0.08, 0.28, 0.84, 0.48), "stamp": ("gaussian_blur", 0.18, 0.18, 0.64, 0.64),
    "signature": ("pixelate", 0.04, 0.12, 0.92, 0.76), "avatar": ("pixelate", 0.08, 0.12, 0.84, 0.76), "account_region": ("pixelate", 0.08, 0.12, 0.84, 0.76), "school_class_identifier": ("pixelate", 0.08, 0.12, 0.84, 0.76),
}
# Category -> padding ratios (x, y) of codes, at least 4 pixels.
PADDED = {"qr_code": (0.05, 0.05), "barcode": (0.08, 0.04)}
# Modes by category where the plan has none of its own.
MODES = {
    "text_pii": "black_box", "face": "gaussian_blur", "qr_code": "black_box", "barcode": "black_box", "signature": "solid_fill", "stamp": "solid_fill", "id_card": "black_box", "bank_card": "black_box",
    "bank_account": "black_box", "address": "black_box", "student_id": "black_box", "date_time": "black_box", "pii_entity": "black_box", "badge": "black_box", "license_plate": "black_box",
}
# Categories that drop a picture, and that are redacted in text and in the picture; those that ask for review.
DROP = ("explicit", "graphic_violence", "self_harm", "other_nsfw")
DROP_TEXT = ("violence", "sexual_content", "self_harm", "hate_speech", "illegal_instruction", "ocr_extraction_failed")
REDACT_TEXT = ("person_name", "phone_number", "email", "id_card", "bank_card", "bank_account", "address", "license_plate", "student_id", "date_time", "pii_entity")
REDACT_VISION = ("face", "id_card", "badge", "qr_code", "barcode", "license_plate", "signature", "stamp")
CONSTRAINED = ("face", "badge", "signature", "stamp", "qr_code", "barcode")
MAX_REDACTED = 0.45
BOX = "struct<x:double,y:double,w:double,h:double>"


def near_boxes(a: DataFrame, b: DataFrame, image: str = "image_id", least_iou: float = 0.05, least_in: float = 0.75) -> DataFrame:
    """Pairs of boxes of one image by overlap: IoU over one bound or containment of another."""
    flat = lambda df, p: df.select(F.col(image).alias(f"{p}i"), F.col("id").alias(f"{p}id"), *[F.col("box")[n].alias(p + n) for n in "xywh"], (F.col("box.x") + F.col("box.w")).alias(f"{p}r"), (F.col("box.y") + F.col("box.h")).alias(f"{p}b"))
    meet = (F.col("pi") == F.col("qi")) & (F.col("pid") < F.col("qid")) & (F.col("px") < F.col("qr")) & (F.col("qx") < F.col("pr")) & (F.col("py") < F.col("qb")) & (F.col("qy") < F.col("pb"))
    j = flat(a, "p").join(flat(b, "q"), meet)
    both = (F.least("pr", "qr") - F.greatest("px", "qx")) * (F.least("pb", "qb") - F.greatest("py", "qy"))
    j = j.withColumn("o", both).withColumn("sp", F.col("pw") * F.col("ph")).withColumn("sq", F.col("qw") * F.col("qh"))
    out = j.select(F.col("pi").alias(image), F.col("pid").alias("id"), F.col("qid").alias("other"), F.try_divide("o", F.col("sp") + F.col("sq") - F.col("o")).alias("iou"), F.try_divide(F.col("o"), F.least("sp", "sq")).alias("containment"))
    return out.filter((F.col("iou") > least_iou) | (F.col("containment") >= least_in))


def merged(findings: DataFrame, image: str = "image_id", least: float = 0.5) -> DataFrame:
    """Findings that stay, in order of id: one that overlaps an earlier one of its category by more than ``least`` goes, or replaces it (at the end) if its score is higher."""
    item = F.struct("id", "score", "category", "box")
    per = findings.groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("x"))
    init = F.array().cast(f"array<struct<id:bigint,score:double,category:string,box:{BOX}>>")

    def step(kept: Column, f: Column) -> Column:
        at = F.array_min(F.array_compact(F.transform(kept, lambda k, i: F.when((k["category"] == f["category"]) & (g.iou(k["box"], f["box"]) > least), i))))
        better = f["score"] > F.get(kept, at)["score"]
        return F.when(at.isNull(), F.concat(kept, F.array(f))).when(better, F.concat(F.filter(kept, lambda k, i: i != at), F.array(f))).otherwise(kept)

    return per.select(image, F.posexplode(F.aggregate("x", init, step)).alias("place", "f")).select(image, "place", "f.id", "f.category", "f.score", "f.box")


def redaction_plan(findings: DataFrame) -> DataFrame:
    """mode and hidden box of every finding with a region: the part that tells who it is, a padded code, or the whole box; text is hidden whole."""
    b, c, text = F.col("box"), F.col("category"), F.col("finding_type").isin("text_pii", "text_content")
    mode = F.when(~text, lookup(c, {k: v[0] for k, v in CORE.items()}))
    box = b
    for k, (x, y) in PADDED.items():
        px, py = F.greatest(F.lit(4.0), b["w"] * x), F.greatest(F.lit(4.0), b["h"] * y)
        box = F.when(~text & (c == k), g.box(b["x"] - px, b["y"] - py, b["w"] + 2 * px, b["h"] + 2 * py)).otherwise(box)
    for k, (_, x, y, w, h) in CORE.items():
        box = F.when(~text & (c == k), g.box(b["x"] + b["w"] * x, b["y"] + b["h"] * y, F.greatest(F.lit(1.0), b["w"] * w), F.greatest(F.lit(1.0), b["h"] * h))).otherwise(box)
    return findings.filter(b.isNotNull()).withColumn("mode", F.coalesce(mode, lookup(c, MODES, "black_box"))).withColumn("box", box)


def policy(findings: DataFrame, context: DataFrame | None = None, least: float = 0.5, drop: float = 0.7, image: str = "image_id") -> DataFrame:
    """image, decision, dataset_action, review_required, reasons of each image.

    findings: image, finding_type, category, score, box, localization_required, redact_only. context: image,
    restricted_use_case, restricted_enabled, authorized, education_value, ordinary_enabled. Unsafe content drops; then a
    restricted use needs authority; then a picture that redaction would spoil drops; then what is private is redacted.
    """
    t, c, s = F.col("finding_type"), F.col("category"), F.col("score")
    text, vision, said, unsafe = t == "text_pii", t == "vision_object", t == "text_content", t == "safety"
    lost = vision & c.isin(*REDACT_VISION) & F.col("box").isNull() & F.col("localization_required")
    hide = (text & c.isin(*REDACT_TEXT)) | (vision & c.isin(*REDACT_VISION) & ~lost) | (unsafe & F.col("redact_only"))
    gone = lost | (said & c.isin(*DROP_TEXT)) | (unsafe & ~F.col("redact_only") & c.isin(*DROP) & (s >= drop))
    look = lost | said | (unsafe & ~F.col("redact_only")) | (vision & c.isin(*CONSTRAINED))
    prefix = F.when(text & hide, "PII_").when(lost, "VISION_UNLOCALIZED_").when(vision & hide, "VISION_").when(said, "TEXT_CONTENT_").when(unsafe, "SAFETY_")
    # what identifies is listed whatever its score
    marks = F.bool_or(c.isin(*CONSTRAINED))
    use = s >= least
    a = findings.groupBy(image).agg(
        F.bool_or(use & gone).alias("d"), F.bool_or(use & hide).alias("h"), F.bool_or(use & look).alias("l"), marks.alias("m"),
        F.array_join(F.array_sort(F.collect_set(F.when(use, F.concat(prefix, F.upper(c))))), ",").alias("reasons"),
    )
    if context is not None:
        a = context.join(a, image, "left").fillna(False, ["d", "h", "l", "m"]).fillna("", ["reasons"])
    else:
        a = a.withColumns({"restricted_use_case": F.lit(""), "restricted_enabled": F.lit(False), "authorized": F.lit(False), "education_value": F.lit(True), "ordinary_enabled": F.lit(True)})
    case = F.trim("restricted_use_case") != ""
    action = (
        F.when(F.col("d"), "do_not_deliver").when(case, F.when(F.col("restricted_enabled") & F.col("authorized"), "deliver_raw_restricted").otherwise("do_not_deliver")).when(~F.col("education_value"), "do_not_deliver")
        .when(F.col("h"), F.when(F.col("l") | F.col("m"), "deliver_redacted_with_constraints").otherwise("deliver_redacted")).when(~F.col("ordinary_enabled") & F.col("restricted_enabled"), "deliver_raw_restricted").otherwise("deliver_raw")
    )
    out = a.withColumn("dataset_action", action)
    act = F.col("dataset_action")
    decision = F.when(act == "do_not_deliver", "drop").when(act.startswith("deliver_redacted"), "pass_redacted").otherwise("pass_raw")
    spoiled = ~F.col("d") & ~case & ~F.col("education_value")
    return out.select(image, decision.alias("decision"), "dataset_action", (F.col("l") | spoiled).alias("review_required"), "reasons")


def education_value(operations: DataFrame, width: float, height: float, image: str = "image_id") -> DataFrame:
    """image, hidden_share, education_value: false where more than ``MAX_REDACTED`` of the picture is hidden."""
    share = F.round(F.sum(g.area(F.col("box"))) / (width * height), 6)
    return operations.groupBy(image).agg(share.alias("hidden_share")).withColumn("education_value", F.col("hidden_share") <= MAX_REDACTED)


def ocr_text(blocks: DataFrame, image: str = "image_id", order: str = "block_id") -> DataFrame:
    """Character range of each line of each block in the image's text (lines joined by line ends)."""
    lines = blocks.select(image, order, F.posexplode(F.split("text", "\n")).alias("line", "t")).filter("t != ''")
    w = Window.partitionBy(image).orderBy(order, "line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("t") + 1).over(w), F.lit(0))
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("t"))


def ocr_summary(blocks: DataFrame, image: str = "image_id") -> DataFrame:
    return blocks.groupBy(image).agg(F.count("*").alias("blocks"), F.round(F.avg("confidence"), 4).alias("confidence"), F.sum(F.length("text")).alias("text_length"))


def char_box(line: Column, text: Column, start: Column, end: Column) -> Column:
    """Part of a line's box that characters start..end take by their widths; one pixel at least."""
    # Widths of characters.
    weight = lambda c: F.when(c.rlike(r"(?U)\s"), 0.35).when(c.rlike(r"(?U)\d"), 0.62).when(c.rlike("[A-Za-z]"), 0.58).when(c.rlike("[一-鿿]"), 1.0).when(c.rlike(r"(?U)\W"), 0.36).otherwise(0.75)
    total = lambda t: F.aggregate(F.transform(F.split(t, ""), weight), F.lit(0.0), lambda s, x: s + x)
    part = lambda a, b: F.when(b > a, total(F.substr(text, a + 1, b - a))).otherwise(0.0)
    whole = total(text)
    x = line["x"] + line["w"] * part(F.lit(0), start) / whole
    return g.box(x, line["y"], F.greatest(F.lit(1.0), line["w"] * part(start, end) / whole), F.greatest(F.lit(1.0), line["h"]))


def union_box(blocks: DataFrame, by: str) -> DataFrame:
    """Bounding box and mean confidence of a group of boxes."""
    b = F.col("box")
    agg = blocks.groupBy(by).agg(F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x"] + b["w"]).alias("x1"), F.max(b["y"] + b["h"]).alias("y1"), F.count("*").alias("boxes"), F.avg("score").alias("confidence"))
    return agg.select(by, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), "boxes", "confidence")


def top_per_category(findings: DataFrame, k: dict[str, int], other: int, image: str = "image_id") -> DataFrame:
    w = Window.partitionBy(image, "category").orderBy(F.col("score").desc(), "id")
    return findings.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= lookup(F.col("category"), k, other)).drop("_r")


def route(width: Column, height: Column, colour_std: Column) -> Column:
    aspect = width / height
    return F.when((aspect < 0.6) | (aspect > 1.8), "document").when(colour_std < 40, "document").when(colour_std > 70, "photo").otherwise("mixed")


def text_region(box: Column) -> Column:
    """A text's box with padding of 0.08 of its height, 3 to 16 pixels."""
    pad = F.greatest(F.lit(3.0), F.least(F.lit(16.0), box["h"] * 0.08))
    return g.box(box["x"] - pad, box["y"] - pad, F.greatest(F.lit(1.0), box["w"] + 2 * pad), F.greatest(F.lit(1.0), box["h"] + 2 * pad))


def reasonable_region(box: Column, text: Column, width: Column | float, height: Column | float) -> Column:
    """Whether a region is small enough for its text: 0.08 of the picture for up to 40 characters, else 0.2."""
    n = F.length(F.regexp_replace(text, "(?U)\\W+", ""))
    return F.greatest(F.lit(1.0), g.area(box)) / (F.lit(width) * F.lit(height)) <= F.when((n > 0) & (n <= 40), 0.08).otherwise(0.2)


# Kinds of text that may stand beside a code.
BESIDE = ("phone_number", "bank_card", "student_id", "account", "social_account", "bank_account", "pii_entity", "combined_identity")


def without_code_texts(text: DataFrame, vision: DataFrame, image: str = "image_id") -> DataFrame:
    """Text findings but for numbers attached to a code: under, over or inside its box."""
    c = vision.filter((F.col("finding_type") == "vision_object") & F.col("category").isin("qr_code", "barcode") & F.col("box").isNotNull()).select(F.col(image).alias("_i"), F.col("box").alias("c"))
    compact = F.regexp_replace("text", r"[\s\-_.]", "")
    letters, digits = F.length(F.regexp_replace(compact, "[^A-Za-z0-9]", "")), F.length(F.regexp_replace(compact, "\\D", ""))
    number = F.col("category").isin(*BESIDE) & F.col("box").isNotNull() & (F.length(compact) >= 6) & (letters >= 6) & (digits / F.greatest(F.lit(1), letters) >= 0.65)
    t, k = F.col("box"), F.col("c")
    across = F.greatest(F.lit(0.0), F.least(t["x"] + t["w"], k["x"] + k["w"]) - F.greatest(t["x"], k["x"])) / F.least(F.greatest(F.lit(1.0), t["w"]), F.greatest(F.lit(1.0), k["w"]))
    px, py = k["w"] * 0.15, k["h"] * 0.25
    inside = (t["x"] >= k["x"] - px) & (t["y"] >= k["y"] - py) & (t["x"] + t["w"] <= k["x"] + k["w"] + px) & (t["y"] + t["h"] <= k["y"] + k["h"] + py)
    below = (t["y"] >= k["y"]) & (t["y"] <= k["y"] + k["h"] + F.greatest(F.lit(8.0), k["h"] * 0.55))
    above = (t["y"] + t["h"] <= k["y"] + k["h"]) & (t["y"] + t["h"] >= k["y"] - F.greatest(F.lit(6.0), k["h"] * 0.25))
    return text.join(c, (F.col(image) == F.col("_i")) & number & (across >= 0.45) & (inside | below | above), "left_anti")


def localisation_quality(box: Column, hint: Column, confidence: Column, dangerous: Column, width: float, height: float) -> Column:
    """Confidence, more by overlap with a hint (or a centre near it), less for large boxes."""
    cx, cy = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
    near = cx.between(hint["x"] - hint["w"] * 0.75, hint["x"] + hint["w"] * 1.75) & cy.between(hint["y"] - hint["h"] * 0.75, hint["y"] + hint["h"] * 1.75)
    size = F.greatest(F.lit(0.0), g.area(box) / (width * height) - F.when(dangerous, 0.2).otherwise(0.35)) * 2
    return confidence + F.greatest(g.iou(box, hint) * 2, F.when(near, 0.35).otherwise(0.0)) - size
