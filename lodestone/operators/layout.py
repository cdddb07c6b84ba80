"""Recall by layout on lines of recognised text: names that stand alone near signs of identity, and blocks of address lines.

Lines are the units of :func:`lodestone.operators.regions.ocr_units` in reading order
(image_id, unit, text, start, end, box, confidence). Groups of address lines are gaps and
islands whose breaks are words, or columns that do not go on.

Edge cases: null texts are empty lines; lines of equal start are ordered by name;
pictures without lines give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as g
from lodestone.operators.picture import text_region

# What a name is, words that are none, words that no name has, and signs of identity around one.
NAME = "[\\u4e00-\\u9fa5·]{2,4}"
NO_NAMES = ("内科", "护理", "血糖", "案例", "学院", "教研室", "助产", "小组", "学时")
NOT_IN_NAMES = ("学院", "大学", "医院", "护理", "教研", "班", "组", "学时", "案例", "课程", "PBL")
SIGNS = (r"\d{2,4}.*班", "小组", "联系电话|联系方式|手机号|电话|邮箱|email", r"1[3-9]\d{9}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\d{4}年\d{1,2}月\d{1,2}日", "学院|学校|大学|教研室")
# Lines of addresses, lines that end a block of them, and what makes a block sure.
ADDRESS = (
    r"\b\d{2,6}\s+[A-Za-z][A-Za-z0-9 .'-]*(?:street|st\.?|road|rd\.?|avenue|ave\.?|cove|prairie|summit|trafficway|hills|apt\.?|suite|unit|box)\b",
    r"\b(?:apt\.?|suite|unit|box)\s*\d+\b",
    r"\b[A-Za-z][A-Za-z .'-]+,\s*[A-Z]{2}\s+\d{4,6}\b",
    r"\bDPO\s+[A-Z]{2}\s+\d{4,6}\b",
)
STOP = r"^(tax id|iban|items|summary|seller:|client:|invoice no|date of issue|<table)"
NUMBER, PLACE, CODE = r"\b\d{2,6}\b", r"\b(?:apt|suite|unit|box|street|st\\.?|road|rd\\.?|ave\\.?|avenue|cove|prairie|summit|trafficway|hills)\b", r"\b[A-Z]{2}\s+\d{4,6}\b"
RISKY = ("address", "地址", "位置")
ORDER = ("start", "unit")


def isolated_names(units: DataFrame) -> DataFrame:
    """image_id, unit, text, start, end, box, category, score: lines that are a name alone, with a sign of identity on the two lines before or the three after."""
    w = Window.partitionBy("image_id").orderBy(*ORDER)
    around = F.concat_ws("\n", *[F.lag("text", k).over(w) for k in (2, 1)], *[F.lead("text", k).over(w) for k in (1, 2, 3)])
    u = units.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_near", around)
    name = F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", "")
    u = u.withColumn("_name", name)
    known = ~F.col("_name").isin(*NO_NAMES)
    for x in NOT_IN_NAMES:
        known = known & ~F.contains("_name", F.lit(x))
    signs = F.lit(False)
    for s in SIGNS:
        signs = signs | F.col("_near").rlike("(?iuUd)" + s)
    found = u.filter(F.col("_name").rlike(f"^{NAME}$") & known & signs)
    return found.select("image_id", "unit", F.col("_name").alias("text"), "start", "end", text_region(F.col("box")).alias("box"), F.lit("person_name").alias("category"), F.lit(0.68).alias("score"))


def stop_line(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(STOP)


def address_line(text: Column) -> Column:
    """Whether a line is part of an address."""
    t = F.trim(text)
    hit = F.lit(False)
    for p in ADDRESS:
        hit = hit | t.rlike("(?i)" + p)
    return (F.length(t) > 0) & (F.length(t) <= 100) & ~stop_line(text) & hit


def same_column(a: Column, b: Column) -> Column:
    """Whether two lines lie under each other: at one left edge or over each other's width, and not far apart."""
    close = F.abs(a["x"] - b["x"]) <= F.greatest(F.lit(80.0), F.least(a["w"], b["w"]) * 0.35)
    across = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])) / F.greatest(F.lit(1.0), F.least(a["w"], b["w"]))
    gap = F.greatest(b["y"] - a["y"] - a["h"], a["y"] - b["y"] - b["h"], F.lit(0.0))
    return (close | (across >= 0.45)) & (gap <= F.greatest(F.lit(60.0), F.greatest(a["h"], b["h"]) * 1.5))


def _joined(lines: DataFrame, by: list[str]) -> DataFrame:
    """Region, text and offsets of groups of lines; a single line has its own box, several the box around them."""
    b = F.col("box")
    per = lines.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("start", "unit", "text"))).alias("lines"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"),
        F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x"] + b["w"]).alias("x1"), F.max(b["y"] + b["h"]).alias("y1"),
    )
    side = lambda a, z: F.when(F.col("n") == 1, F.col(z) - F.col(a)).otherwise(F.greatest(F.lit(1.0), F.col(z) - F.col(a)))
    return per.withColumn("box", text_region(g.box(F.col("x"), F.col("y"), side("x", "x1"), side("y", "y1")))).drop("x", "y", "x1", "y1")


def address_groups(units: DataFrame) -> DataFrame:
    """image_id, grp, text, start, end, units, box, confidence, score: address lines that follow each other in one column, with two signs of an address at least."""
    w = Window.partitionBy("image_id").orderBy(*ORDER)
    u = units.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_a", address_line(F.col("text")))
    before, box = F.lag("_a").over(w), F.lag("box").over(w)
    u = u.withColumns({"_pa": before, "_pb": box}).withColumn("_new", (~F.coalesce("_pa", F.lit(False)) | ~F.coalesce(same_column(F.col("_pb"), F.col("box")), F.lit(True))).cast("int"))
    u = u.withColumn("grp", F.sum(F.when(F.col("_a"), F.col("_new")).otherwise(0)).over(w)).filter("_a")
    j = _joined(u, ["image_id", "grp"])
    text = F.array_join("lines.text", " ")
    signs = text.rlike(NUMBER).cast("int") + text.rlike("(?i)" + PLACE).cast("int") + text.rlike(CODE).cast("int") + F.contains(text, F.lit(",")).cast("int")
    j = j.withColumn("score", signs).filter("score >= 2")
    return j.select("image_id", "grp", F.array_join(F.transform("lines.text", lambda t: F.trim(t)), "\n").alias("text"), "start", "end", F.array_join("lines.unit", ",").alias("units"), "box", "confidence", "score")


def recalled_addresses(units: DataFrame, said: DataFrame, known: DataFrame) -> DataFrame:
    """Address groups of pictures of which a document-level assessment speaks of addresses (said: image_id, text) and of which none is known yet (image_id); each text once."""
    low = F.lower(F.coalesce("text", F.lit("")))
    risky = F.lit(False)
    for x in RISKY:
        risky = risky | F.contains(low, F.lit(x))
    groups = address_groups(units).join(said.filter(risky).select("image_id").distinct(), "image_id", "left_semi").join(known.select("image_id"), "image_id", "left_anti")
    first = groups.groupBy("image_id", "text").agg(F.min("grp").alias("grp"))
    return groups.join(first, ["image_id", "text", "grp"])


def expanded_addresses(spans: DataFrame, units: DataFrame) -> DataFrame:
    """image_id, span_id, units, start, end, box, confidence: the address around each span (image_id, span_id, start, end).

    From each line that the span is on, lines before and after are taken as long as they are address lines in that line's column; the
    line itself is, if it is one. Lines are met by their run of address lines, so a line meets no more than its neighbours in one.
    """
    w = Window.partitionBy("image_id").orderBy(*ORDER)
    u = units.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_a", address_line(F.col("text"))).withColumn("_i", F.row_number().over(w))
    u = u.withColumn("_run", F.sum(F.when(F.col("_a"), 0).otherwise(1)).over(w))  # address lines after the same other line are one run
    e = F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.col("start") + 1)
    s = spans.filter("start is not null").select("image_id", "span_id", F.col("start").alias("_s"), e.alias("_e"))
    anchor = s.join(u, "image_id").filter((F.greatest("_s", "start") < F.least("_e", "end"))).select("image_id", "span_id", F.col("_i").alias("_at"), F.col("_a").alias("_own"), F.col("_run").alias("_r"), F.col("box").alias("_box"), F.col("unit").alias("_u"))
    own = anchor.filter("_own").select("image_id", "span_id", F.col("_u").alias("unit"))
    # after any line comes the run of its number; before a line that is none comes the run of the number before
    look = anchor.withColumn("_run", F.explode(F.when(F.col("_own"), F.array("_r")).otherwise(F.array(F.col("_r"), F.col("_r") - 1))))
    near = look.join(u.filter("_a").select("image_id", "_run", "_i", "unit", "box"), ["image_id", "_run"]).filter("_i != _at").withColumn("_d", F.abs(F.col("_i") - F.col("_at"))).withColumn("_up", F.col("_i") > F.col("_at"))
    run = Window.partitionBy("image_id", "span_id", "_at", "_up").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_ok", same_column(F.col("_box"), F.col("box")))
    near = near.withColumn("_all", F.min(F.col("_ok").cast("int")).over(run)).filter("_all = 1")
    every = own.unionByName(near.select("image_id", "span_id", "unit")).distinct().join(u.select("image_id", "unit", "text", "start", "end", "box", "confidence"), ["image_id", "unit"])
    return _joined(every, ["image_id", "span_id"]).select("image_id", "span_id", F.array_join("lines.unit", ",").alias("units"), "start", "end", "box", "confidence")
