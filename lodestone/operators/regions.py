"""Places of text in pictures: units of recognised text with their offsets, and the region of each text span.

A picture's text is the text of its non-empty blocks joined by line ends of no place of
their own. A span of it, by offsets or by its words, is resolved in five stages, each on
what the ones before left open; ``source`` says which one answered:

spotting: recognised instances (single words or lines with places of their own) that hold the span or are held by it;
char_span: units that the span's offsets overlap;
text_match: blocks that hold the span's text or are held by it;
fuzzy_block: the one block alike to it;
fuzzy_union: all blocks alike to it, if there are several.

Texts are compared without marks and in small letters. Spans and
units of a picture of few are compared as they are; those of larger pictures are dealt into
blocks, and two blocks at a time are compared by counts of shared character pairs, so that no
picture is one task and only pairs that are found become rows.

Edge cases: null texts are empty; spans without words skip the text stages, spans
without a start skip char_span; an empty end is one character after the start; spans
that no stage resolves give no row; repeated blocks are blocks; ties go to the smaller
number; pictures without a size are as large as their blocks reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import geometry as g
from lodestone.operators.picture import char_box, reasonable_region, text_region
from lodestone.tables import Steps

STRETCH = 1024
#: where a line of a block of several ends
_ENDS = "\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}"
LINE = f"[^{_ENDS}]*(?:\\r\\n|[{_ENDS}])|[^{_ENDS}]+"
FUZZY, ALIKE = 0.56, 0.72
#: spans times units of a picture that are compared as they are; those of larger pictures are compared in blocks
FEW = 4096
#: rows of a block
TILE = 256


def block_starts(blocks: DataFrame) -> DataFrame:
    """Blocks (image_id, block, text, ...) that hold text, with the offset at which each starts in the picture's text.

    Running sums within stretches of blocks, over sums of stretches: no picture is one task.
    """
    b = blocks.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("_s", F.floor(F.col("block") / STRETCH)).withColumn("_n", F.length("text").cast("long") + 1)
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = b.groupBy("image_id", "_s").agg(F.sum("_n").alias("_t"))
    sums = sums.select("image_id", "_s", before(Window.partitionBy("image_id").orderBy("_s"), "_t").alias("_b"))
    own = b.withColumn("_o", before(Window.partitionBy("image_id", "_s").orderBy("block"), "_n"))
    return own.join(sums, ["image_id", "_s"]).withColumn("start", F.col("_b") + F.col("_o")).drop("_s", "_n", "_o", "_b")


def ocr_units(blocks: DataFrame) -> DataFrame:
    """Units of recognised text: a block of one line, or each line of a block of several that is not blank.

    image_id, block, line (0 for a whole block), unit (its name), text, start, end, box, confidence, char_boxes: those of
    the unit's visible characters. A line's box is its share of the block's height.
    """
    b = block_starts(blocks)
    # a block is one row, and so are its lines together
    many = F.instr("text", "\n") > 0
    lines = F.when(many, F.regexp_extract_all("text", F.lit(LINE), F.lit(0))).otherwise(F.array("text"))
    x = b.withColumn("_many", many).select("*", F.posexplode(lines).alias("_k", "_raw")).drop("text")
    w = Window.partitionBy("image_id", "block", "start").orderBy("_k")
    held = lambda c, until: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, until)), F.lit(0))
    x = x.withColumn("text", F.when(F.col("_many"), F.regexp_replace("_raw", "[\\r\\n]+$", "")).otherwise(F.col("_raw")))
    x = x.withColumn("_full", (~F.col("_many") | F.col("_raw").rlike("(?U)[^\\s\\x1C-\\x1F]")).cast("int"))
    seen = F.length(F.regexp_replace("_raw", "[\\r\\n]", ""))
    x = x.withColumns({"_at": held(F.length("_raw"), -1), "_seen": held(seen, -1), "_i": held("_full", -1), "_all": F.sum("_full").over(Window.partitionBy("image_id", "block", "start"))})
    h = F.when(F.col("_many"), F.greatest(F.lit(1.0), F.col("box.h") / F.greatest(F.lit(1), "_all"))).otherwise(F.col("box.h"))
    y = F.col("box.y") + F.when(F.col("_many"), h * F.col("_i")).otherwise(0.0)
    name = F.concat(F.lit("block_"), F.lpad((F.col("block") + 1).cast("string"), 4, "0"))
    own = F.when(F.col("char_boxes").isNotNull(), F.slice("char_boxes", (F.col("_seen") + 1).cast("int"), F.length(F.regexp_replace("text", "[\\r\\n]", ""))))
    return x.filter("_full = 1").select(
        "image_id", "block", F.when(F.col("_many"), F.col("_k") + 1).otherwise(0).alias("line"),
        F.when(F.col("_many"), F.concat(name, F.lit("_line_"), F.lpad((F.col("_k") + 1).cast("string"), 4, "0"))).otherwise(name).alias("unit"),
        "text", (F.col("start") + F.col("_at")).alias("start"), (F.col("start") + F.col("_at") + F.length("text")).alias("end"), g.box(F.col("box.x"), y, F.col("box.w"), h).alias("box"), "confidence", own.alias("char_boxes"),
    )


def offset_map(blocks: DataFrame) -> DataFrame:
    """Every character of a picture's text: index, virtual (a line end between blocks), block, local (index in the block), char."""
    b = block_starts(blocks)
    chars = b.select("image_id", "block", "start", F.posexplode(F.split("text", "")).alias("local", "char")).filter("char != ''")
    real = chars.select("image_id", (F.col("start") + F.col("local")).alias("index"), F.lit(False).alias("virtual"), "block", "local", "char")
    none = F.lit(None)
    between = b.filter("start > 0").select("image_id", (F.col("start") - 1).alias("index"), F.lit(True).alias("virtual"), none.cast(dict(b.dtypes)["block"]).alias("block"), none.cast("int").alias("local"), F.lit("\n").alias("char"))
    return real.unionByName(between)


def plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\W+", ""))


def letters_of(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def pairs_of(t: Column) -> Column:
    """Distinct pairs of neighbouring characters; the text itself if shorter."""
    pairs = lambda c: F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b)))
    return F.when(F.length(t) <= 2, F.array(t)).otherwise(g.once(letters_of(t), pairs))


def alike(spans: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (image_id, span_id, unit_id, held, likeness) of spans and units with words (column ``norm``): one holds the other, or likeness is at least ``FUZZY``.

    Likeness is the ratio of lengths if one holds the other, else the Jaccard coefficient of character pairs.
    """
    s = spans.filter("norm != ''").select("image_id", F.lit(0).alias("side"), F.col("span_id").alias("id"), "norm").distinct()
    u = units.filter("norm != ''").select("image_id", F.lit(1).alias("side"), F.col("unit_id").alias("id"), "norm")
    steps = Steps(spans.sparkSession)
    every = steps.keep(s.unionByName(u).withColumn("two", pairs_of(F.col("norm"))))
    sides = steps.keep(every.groupBy("image_id").agg(F.count_if(F.col("side") == 0).alias("ns"), F.count_if(F.col("side") == 1).alias("nu")))
    text = lambda side, name, t: every.filter(F.col("side") == side).select("image_id", F.col("id").alias(name), F.col("norm").alias(t), F.col("two").alias(f"{t}2"))
    few = sides.filter(F.col("ns") * F.col("nu") <= FEW).select("image_id")
    near = text(0, "span_id", "a").join(few, "image_id").join(text(1, "unit_id", "b"), "image_id")
    a, b = F.col("a"), F.col("b")
    held = F.contains(a, b) | F.contains(b, a)
    n, m = F.size("a2"), F.size("b2")
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    # sizes alone rule out most pairs
    alike_by = F.when(F.least(n, m) >= F.greatest(n, m) * FUZZY, g.once(F.size(F.array_intersect("a2", "b2")), lambda both: both / (n + m - both))).otherwise(0.0)
    met = near.select("image_id", "span_id", "unit_id", held.alias("held"), F.when(held, ratio).otherwise(alike_by).alias("likeness"))
    far = alike_in_blocks(every, sides.filter(F.col("ns") * F.col("nu") > FEW))
    out = steps.keep(met.filter(F.col("held") | (F.col("likeness") >= FUZZY)).unionByName(far))
    steps.leave(out)
    return out


def alike_in_blocks(every: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs as :func:`alike` gives them, of the pictures in ``sides`` (image_id, ns, nu: spans and units). every: image_id, side (0 spans, 1 units), id, norm.

    Every block of spans meets every block of its picture's units; a task holds two blocks at a time.
    """
    kind = dict(every.dtypes)
    blocks = lambda n: F.ceil(F.col(n) / TILE)
    span = F.col("side") == 0
    x = every.join(sides, "image_id").withColumn("own", F.pmod(F.xxhash64("id"), F.when(span, blocks("ns")).otherwise(blocks("nu"))))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(span, blocks("nu")).otherwise(blocks("ns")) - 1)))
    x = x.select("image_id", "side", "id", "norm", F.when(span, F.col("own")).otherwise(F.col("other")).alias("sb"), F.when(span, F.col("other")).otherwise(F.col("own")).alias("ub"))
    return x.groupBy("image_id", "sb", "ub").applyInArrow(_compared, f"image_id {kind['image_id']}, span_id {kind['id']}, unit_id {kind['id']}, held boolean, likeness double")


def _compared(t: pa.Table) -> pa.Table:
    """The pairs of two blocks: one holds the other, or shared pairs of characters reach ``FUZZY``."""
    side = t["side"].to_numpy()
    s, u = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    norm = t["norm"].to_pylist()
    two = [{x} if len(x) <= 2 else set(map("".join, zip(x, x[1:]))) for x in norm]
    number: dict[str, int] = {}
    n, length = np.array([len(x) for x in two]), np.array([len(x) for x in norm])
    has = np.zeros((len(norm), len(set().union(*two))), np.float32)
    for k, own in enumerate(two):
        has[k, [number.setdefault(x, len(number)) for x in own]] = 1
    both = (has[s] @ has[u].T).astype(np.int64)
    a, b = n[s][:, None], n[u][None, :]
    # who holds a text of three characters or more has all its pairs
    held = (both == np.minimum(a, b)) | (np.minimum(length[s][:, None], length[u][None, :]) <= 2)
    for i, j in zip(*np.nonzero(held)):
        x, y = norm[s[i]], norm[u[j]]
        held[i, j] = x in y or y in x
    ratio = np.minimum(length[s][:, None], length[u][None, :]) / np.maximum(length[s][:, None], length[u][None, :])
    likeness = np.where(held, ratio, np.where(np.minimum(a, b) >= np.maximum(a, b) * FUZZY, both / (a + b - both), 0.0))
    i, j = np.nonzero(held | (likeness >= FUZZY))
    return pa.table({"image_id": t["image_id"].take(pa.array(s[i])), "span_id": t["id"].take(pa.array(s[i])), "unit_id": t["id"].take(pa.array(u[j])), "held": pa.array(held[i, j]), "likeness": pa.array(likeness[i, j], pa.float64())})


def local_span(text: Column, part: Column, norm: Column, part_norm: Column) -> Column:
    """Where ``part`` stands in ``text``: struct of start and end, as it is or else without marks and in small letters (``norm``); null if nowhere."""
    at, p = F.instr(text, part), F.instr(norm, part_norm)
    direct = F.struct((at - 1).alias("start"), (at - 1 + F.length(part)).alias("end"))
    words = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].rlike("(?U)\\w"))
    loose = lambda w: F.struct(F.get(w, p - 1)["i"].alias("start"), (F.get(w, F.least(F.size(w), p + F.length(part_norm) - 1) - 1)["i"] + 1).alias("end"))
    return F.when((text == "") | (part == ""), None).when(at > 0, direct).when((part_norm != "") & (p > 0), g.once(words, loose))


def char_region(unit: Column, start: Column, end: Column, source: str) -> Column:
    """Padded region (box, confidence, source) of some characters of a unit: by their own boxes, the whole unit, or by their widths."""
    text = unit["text"]
    lo = F.greatest(F.lit(0), F.least(F.length(text), start))
    hi = F.greatest(lo + 1, F.least(F.length(text), end))
    boxes = F.filter(F.slice(F.coalesce(unit["char_boxes"], F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")), (lo + 1).cast("int"), (hi - lo).cast("int")), lambda b: b.isNotNull())
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    x1, y1 = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    of = lambda box, confidence, how: F.struct(text_region(box).alias("box"), confidence.cast("double").alias("confidence"), F.lit(f"{source}_{how}").alias("source"))
    own = of(g.box(x, y, F.greatest(F.lit(1.0), x1 - x), F.greatest(F.lit(1.0), y1 - y)), unit["confidence"], "char_boxes")
    return F.when(F.size(boxes) > 0, own).when((lo <= 0) & (hi >= F.length(text)), of(unit["box"], unit["confidence"], "full_block")).otherwise(of(char_box(unit["box"], text, lo, hi), F.greatest(F.lit(0.01), unit["confidence"] * 0.82), "weighted_estimate"))


def _full(unit: Column, source: str) -> Column:
    return F.struct(text_region(unit["box"]).alias("box"), unit["confidence"].cast("double").alias("confidence"), F.lit(source).alias("source"))


def quality(span: Column, unit: Column, norm: Column) -> Column:
    """How well a unit fits a text (both without marks): equal or held, alike in length, confident, small."""
    area = F.greatest(F.lit(1.0), g.area(unit["box"]))
    exact = F.when(span == norm, 1.0).when(F.contains(norm, span), 0.5).otherwise(0.0)
    ratio = F.least(F.length(span), F.length(norm)) / F.greatest(F.length(span), F.length(norm))
    return F.when(norm == "", 0.0).otherwise(exact + ratio + unit["confidence"] - F.least(area / 1_000_000, F.lit(1.0)))


_UNIT = ("text", "box", "confidence", "char_boxes")


def _best(j: DataFrame) -> DataFrame:
    """image_id, span_id, region of the greatest score. A filter on ``region`` in front of the groups would be pushed down and make each region many times."""
    own = F.when(F.col("region").isNotNull(), F.struct(-F.col("score"), "unit_id"))
    return j.groupBy("image_id", "span_id").agg(F.min_by("region", own).alias("region")).filter("region is not null")


def spotted(spans: DataFrame, instances: DataFrame) -> DataFrame:
    """image_id, span_id, region: the best instance that holds the span (or is held by it, else is alike) and has its place."""
    i = instances.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.regexp_replace("text", "(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$", ""))
    i = i.withColumn("norm", plain(F.col("text"))).withColumnRenamed("instance", "unit_id")
    met = alike(spans, i)
    any_held = met.groupBy("image_id", "span_id").agg(F.max("held").alias("any_held"))
    met = met.join(any_held, ["image_id", "span_id"]).filter(F.col("held") | (~F.col("any_held") & (F.col("likeness") >= ALIKE)))
    j = met.join(spans.select("image_id", "span_id", "text", F.col("norm").alias("span_norm")).withColumnRenamed("text", "span_text"), ["image_id", "span_id"])
    j = j.join(i.select("image_id", "unit_id", "norm", "source", F.struct(*_UNIT).alias("u")), ["image_id", "unit_id"])
    bonus = F.when(F.contains("source", F.lit("char")), 2.0).when(F.contains("source", F.lit("rec_poly")), 1.5).when(F.contains("source", F.lit("spotting")), 1.0).otherwise(0.0)
    score = F.when(F.col("held"), quality(F.col("span_norm"), F.col("u"), F.col("norm"))).otherwise(F.col("likeness")) + F.coalesce(bonus, F.lit(0.0))
    j = j.withColumn("at", local_span(F.col("u.text"), F.col("span_text"), F.col("norm"), F.col("span_norm"))).withColumn("score", score)
    region = F.when(F.col("at").isNotNull(), char_region(F.col("u"), F.col("at.start"), F.col("at.end"), "spotting")).when(F.contains("norm", "span_norm"), _full(F.col("u"), "spotting_full_instance"))
    return _best(j.withColumn("region", region))


def by_offsets(spans: DataFrame, units: DataFrame, images: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, span_id, region: the part of the one unit that a span's offsets overlap, or all of several, or null where neither is of a fitting size. An interval join in stretches of offsets."""
    s = spans.filter("start is not null").select("image_id", "span_id", "text", F.col("start").cast("long").alias("s"), F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.col("start") + 1).cast("long").alias("e")).filter("s < e")
    over = lambda a, b: F.explode(F.sequence(F.floor(a / stretch), F.floor((b - 1) / stretch)))
    s = s.withColumn("b", over(F.col("s"), F.col("e")))
    u = units.filter("start < end").withColumn("b", over(F.col("start"), F.col("end")))
    u = u.select("image_id", "b", F.col("start").alias("us"), F.col("end").alias("ue"), F.struct(*_UNIT).alias("u"))
    lo, hi = F.greatest("s", "us"), F.least("e", "ue")
    # a pair is made in the first stretch that both are in
    j = s.join(u, ["image_id", "b"]).filter((lo < hi) & (F.col("b") == F.floor(lo / stretch)))
    box = F.col("u.box")
    item = F.struct("us", "u", (lo - F.col("us")).alias("lo"), (hi - F.col("us")).alias("hi"))
    per = j.groupBy("image_id", "span_id").agg(F.first("text").alias("text"), F.count("*").alias("n"), F.min_by(item, "us").alias("one"), F.avg("u.confidence").alias("c"), F.min(box["x"]).alias("x"), F.min(box["y"]).alias("y"), F.max(box["x"] + box["w"]).alias("x1"), F.max(box["y"] + box["h"]).alias("y1"))
    per = per.join(images, "image_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    one = F.col("one")
    part = char_region(one["u"], one["lo"], one["hi"], "char_span")
    per = per.withColumn("part", part)
    said = F.when(F.col("text") == "", one["u"]["text"]).otherwise(F.col("text"))
    covers = (one["lo"] <= 0) & (one["hi"] >= F.length(one["u"]["text"]))
    union = g.box(F.col("x"), F.col("y"), F.greatest(F.lit(1.0), F.col("x1") - F.col("x")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y")))
    several = F.struct(text_region(union).alias("box"), F.col("c").alias("confidence"), F.lit("char_span_multi_block_union").alias("source"))
    region = F.when(F.col("n") == 1, F.when(_small(F.col("part.box"), said) | ~covers, F.col("part"))).when(_small(union, F.col("text")), several)
    return per.select("image_id", "span_id", region.alias("region"))


def _small(box: Column, text: Column) -> Column:
    """Whether a region is small enough for its text; any is in a picture without a size."""
    return F.coalesce(F.col("width") * F.col("height") <= 0, F.lit(True)) | F.coalesce(reasonable_region(box, text, F.col("width"), F.col("height")), F.lit(True))


def by_text(spans: DataFrame, met: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, span_id, region: the best block that holds the span's text, or is held by it, and gives a region of a fitting size."""
    wordless = blocks.filter("norm = ''").join(images, "image_id", "left")
    # a block without words is held by every text, at quality 0: only the first one of a fitting size can be chosen
    first = wordless.groupBy("image_id").agg(*[F.min(F.when(_small(F.col("box"), F.lit(t)), F.col("unit_id"))).alias(f"b{k}") for k, t in enumerate(("x", ""))])
    short = F.length("norm") <= 40
    loose = spans.filter("norm != ''").join(first, "image_id").select("image_id", "span_id", F.when(short, F.col("b0")).otherwise(F.col("b1")).alias("unit_id")).filter("unit_id is not null")
    j = met.filter("held").select("image_id", "span_id", "unit_id").unionByName(loose)
    j = j.join(spans.select("image_id", "span_id", F.col("text").alias("span_text"), F.col("norm").alias("span_norm")), ["image_id", "span_id"]).join(blocks.select("image_id", "unit_id", "norm", F.struct(*_UNIT).alias("u")), ["image_id", "unit_id"]).join(images, "image_id", "left")
    j = j.withColumn("at", local_span(F.col("u.text"), F.col("span_text"), F.col("norm"), F.col("span_norm"))).withColumn("score", quality(F.col("span_norm"), F.col("u"), F.col("norm")))
    j = j.withColumn("part", char_region(F.col("u"), F.col("at.start"), F.col("at.end"), "text_match"))
    region = F.when(F.col("at").isNotNull(), F.when(_small(F.col("part.box"), F.col("span_text")), F.col("part"))).when(_small(F.col("u.box"), F.col("span_text")), _full(F.col("u"), "text_match_full_block"))
    return _best(j.withColumn("region", region))


def by_likeness(spans: DataFrame, met: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, span_id, region: the one block of a fitting size that is alike, or all such blocks together if that is of a fitting size."""
    j = met.filter(F.col("likeness") >= FUZZY).join(spans.select("image_id", "span_id", F.col("text").alias("span_text")), ["image_id", "span_id"]).join(blocks.select("image_id", "unit_id", "box", "confidence"), ["image_id", "unit_id"]).join(images, "image_id", "left")
    j = j.filter(_small(F.col("box"), F.col("span_text")))
    b = F.col("box")
    per = j.groupBy("image_id", "span_id").agg(F.count("*").alias("n"), F.first("span_text").alias("t"), F.first("width").alias("width"), F.first("height").alias("height"), F.avg("confidence").alias("c"), F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x"] + b["w"]).alias("x1"), F.max(b["y"] + b["h"]).alias("y1"))
    one = F.col("n") == 1
    box = g.box(F.col("x"), F.col("y"), F.when(one, F.col("x1") - F.col("x")).otherwise(F.greatest(F.lit(1.0), F.col("x1") - F.col("x"))), F.when(one, F.col("y1") - F.col("y")).otherwise(F.greatest(F.lit(1.0), F.col("y1") - F.col("y"))))
    per = per.withColumn("all", box).filter(one | _small(F.col("all"), F.col("t")))
    return per.select("image_id", "span_id", F.struct(text_region(F.col("all")).alias("box"), F.col("c").alias("confidence"), F.when(one, "fuzzy_text_match_full_block").otherwise("fuzzy_text_match_union").alias("source")).alias("region"))


def picture_sizes(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """image_id, width, height: as given, or as far as the blocks reach."""
    b = F.col("box")
    reach = blocks.groupBy("image_id").agg(F.max(b["x"] + b["w"]).alias("_r"), F.max(b["y"] + b["h"]).alias("_b"))
    given = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    out = reach.join(images.select("image_id", "width", "height"), "image_id", "left")
    return out.select("image_id", F.when(given, F.col("width")).otherwise(F.greatest("_r", F.lit(0.0))).cast("double").alias("width"), F.when(given, F.col("height")).otherwise(F.greatest("_b", F.lit(0.0))).cast("double").alias("height"))


def span_regions(spans: DataFrame, blocks: DataFrame, instances: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, span_id, stage (1 to 5), source, box, confidence of every span that a stage resolves.

    spans: image_id, span_id, text, start, end; blocks: image_id, block, text, box, confidence, char_boxes; instances: the
    same with instance and source in place of block; images: image_id, width, height.
    """
    steps = Steps(spans.sparkSession)
    blocks = steps.keep(blocks.select("image_id", "block", F.coalesce("text", F.lit("")).alias("text"), "box", "confidence", "char_boxes"))
    sizes = steps.keep(picture_sizes(images, blocks))
    open_ = steps.keep(spans.select("image_id", "span_id", F.coalesce("text", F.lit("")).alias("text"), "start", "end", plain(F.col("text")).alias("norm")))
    units = blocks.withColumn("norm", plain(F.col("text"))).withColumnRenamed("block", "unit_id")
    done = []

    def left(found: DataFrame) -> DataFrame:
        found = steps.keep(found)
        done.append(found)
        return steps.keep(open_.join(found.filter("region is not null"), ["image_id", "span_id"], "left_anti"))

    open_ = left(spotted(open_, instances))
    open_ = left(by_offsets(open_, ocr_units(blocks), sizes))
    met = steps.keep(alike(open_, units))
    open_ = left(by_text(open_, met, units, sizes))
    done.append(steps.keep(by_likeness(open_, met.join(open_, ["image_id", "span_id"], "left_semi"), units, sizes)))
    steps.leave(*done)
    every = None
    for k, found in enumerate(done):
        stage = F.when(F.col("region.source") == "fuzzy_text_match_union", 5).otherwise(k + 1)
        own = found.filter("region is not null").select("image_id", "span_id", stage.alias("stage"), "region.source", "region.box", "region.confidence")
        every = own if every is None else every.unionByName(own)
    return every
