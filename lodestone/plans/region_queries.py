"""Regions of text spans: conversations stand for pictures, their turns for blocks of recognised text; places come from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import regions
from lodestone.queries import query, table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns; the second one is there twice, and every fifth picture has a rule of dashes. The third has boxes for its characters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    twice = c.filter("turn = 1").withColumn("turn", F.col("turn") + 100)
    dashes = c.filter("turn = 0 and conv_id % 5 = 0").select("conv_id", (F.col("turn") + 200).alias("turn"), F.lit("---").alias("text"))
    b = c.unionByName(twice).unionByName(dashes)
    t, big = F.col("turn"), F.col("turn") == 3
    lines = F.length("text") - F.length(F.regexp_replace("text", "\n", ""))
    box = g.box((t * 37) % 100, t * 60, F.when(big, 1200).otherwise(300 + F.length("text") % 200), F.when(big, 900).otherwise(20 * (1 + lines)))
    seen = F.length(F.regexp_replace("text", "\n", ""))
    chars = F.when((t == 2) & (seen > 0), F.transform(F.sequence(F.lit(0), seen - 1), lambda k: g.box(k * 8, t * 60, F.lit(8), F.lit(16))))
    return b.select(F.col("conv_id").alias("image_id"), t.alias("block"), "text", box.alias("box"), ((F.col("conv_id") * 7 + t * 13) % 100 / 100.0).cast("double").alias("confidence"), chars.alias("char_boxes"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third and fourth word of every first turn."""
    c = table(spark, sf_dir, "conversations").filter("turn = 0")
    words = F.concat_ws(" ", F.get(F.split("text", " "), F.lit(2)), F.get(F.split("text", " "), F.lit(3)))
    none = F.lit(None).cast("array<struct<x:double,y:double,w:double,h:double>>")
    return c.select(F.col("conv_id").alias("image_id"), F.lit(0).alias("instance"), words.alias("text"), g.box(F.lit(5), F.col("conv_id") % 50, F.lit(90), F.lit(18)).alias("box"), F.lit(0.9).alias("confidence"), F.lit("spotting").alias("source"), none.alias("char_boxes"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every turn: a stretch of offsets; part of the text in small letters; the text with a gap; words of the first turn joined by a dash; words that are nowhere."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    t, text = F.col("turn"), F.col("text")
    words = F.lower(F.concat_ws("-", F.get(F.split(text, " "), F.lit(2)), F.get(F.split(text, " "), F.lit(3))))
    none = F.lit(None)
    kinds = [
        (none.cast("string"), (t * 50 + 3).cast("long"), (t * 90 + 13).cast("long")), (F.lower(F.substring(text, 10, 25)), none.cast("long"), none.cast("long")),
        (F.concat(F.substring(text, 1, 30), F.substring(text, 45, 100000)), none.cast("long"), none.cast("long")), (F.when(t == 0, words), none.cast("long"), none.cast("long")), (F.lit("zzzz qqqq"), none.cast("long"), none.cast("long")),
    ]
    items = F.array(*[F.struct(F.lit(k).alias("k"), a.alias("text"), s.alias("start"), e.alias("end")) for k, (a, s, e) in enumerate(kinds)])
    return c.select(F.col("conv_id").alias("image_id"), t, F.explode(items).alias("x")).select("image_id", (t * 10 + F.col("x.k")).alias("span_id"), "x.text", "x.start", "x.end")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(i.alias("image_id"), F.when(i % 4 == 0, 0.0).otherwise(1000.0).alias("width"), F.lit(1400.0).alias("height"))


_ENDS = "\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}"
_BLOCKS = r"""c AS (SELECT conv_id AS i, turn AS b, coalesce(text, '') AS text FROM conversations),
k0 AS (FROM c UNION ALL SELECT i, b + 100, text FROM c WHERE b = 1 UNION ALL SELECT i, b + 200, '---' FROM c WHERE b = 0 AND i % 5 = 0),
k AS (SELECT *, ((b * 37) % 100)::DOUBLE AS x, (b * 60)::DOUBLE AS y, CASE WHEN b = 3 THEN 1200.0 ELSE 300 + length(text) % 200 END::DOUBLE AS w,
  CASE WHEN b = 3 THEN 900.0 ELSE 20 * (1 + length(text) - length(replace(text, chr(10), ''))) END::DOUBLE AS h, ((i * 7 + b * 13) % 100 / 100.0)::DOUBLE AS conf,
  CASE WHEN b = 2 THEN length(replace(text, chr(10), '')) ELSE 0 END AS nvis FROM k0),
s0 AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY i ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k WHERE text <> '')"""
_UNITS = rf"""l0 AS (SELECT *, contains(text, chr(10)) AS many, CASE WHEN contains(text, chr(10)) THEN regexp_extract_all(text, '[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+') ELSE [text] END AS lines FROM s0),
l1 AS (SELECT * EXCLUDE (lines), unnest(lines) AS raw, generate_subscripts(lines, 1) AS n FROM l0),
l2 AS (SELECT *, CASE WHEN many THEN regexp_replace(raw, '[\r\n]+$', '') ELSE raw END AS t, (NOT many OR trim(raw, E' \t\n\r\x0B\x0C') <> '')::INT AS shown FROM l1),
l3 AS (SELECT *, coalesce(sum(length(raw)) OVER v, 0)::BIGINT AS pos, coalesce(sum(length(replace(raw, chr(10), ''))) OVER v, 0)::BIGINT AS seen, coalesce(sum(shown) OVER v, 0) AS above, sum(shown) OVER (PARTITION BY i, b) AS shows
  FROM l2 WINDOW v AS (PARTITION BY i, b ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT i, b, CASE WHEN many THEN n ELSE 0 END AS line, t, start + pos AS s, start + pos + length(t) AS e, x, CASE WHEN many THEN y + greatest(1.0, h / shows) * above ELSE y END AS y, w,
  CASE WHEN many THEN greatest(1.0, h / shows) ELSE h END AS h, conf, CASE WHEN b = 2 THEN least(length(t), nvis - seen) ELSE 0 END AS nvis, seen FROM l3 WHERE shown = 1)"""


@query(f"""WITH {_BLOCKS}, {_UNITS}
SELECT i AS image_id, b AS block, line::INTEGER AS line, 'block_' || lpad((b + 1)::VARCHAR, 4, '0') || CASE WHEN line > 0 THEN '_line_' || lpad(line::VARCHAR, 4, '0') ELSE '' END AS unit, t AS text, s AS start, e AS "end",
  round(y, 6) AS y, round(h, 6) AS h, nvis AS char_boxes FROM u""")
def ocr_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = regions.ocr_units(blocks(spark, sf_dir))
    return u.select("image_id", "block", "line", "unit", "text", "start", "end", F.round("box.y", 6).alias("y"), F.round("box.h", 6).alias("h"), F.coalesce(F.size("char_boxes"), F.lit(0)).cast("bigint").alias("char_boxes"))


@query(f"""WITH {_BLOCKS}
SELECT i AS image_id, start + k AS index, false AS virtual, b AS block, k::INTEGER AS local, substr(text, k::INTEGER + 1, 1) AS char FROM (SELECT *, unnest(range(0, length(text))) AS k FROM s0)
UNION ALL SELECT i, start - 1, true, -1, -1, chr(10) FROM s0 WHERE start > 0""")
def ocr_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = regions.offset_map(blocks(spark, sf_dir))
    return m.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("block", "local")})


def _n(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g'))"


def _two(x: str) -> str:
    return f"(CASE WHEN length({x}) <= 2 THEN [{x}] ELSE list_distinct([substr({x}, q, 2) FOR q IN range(1, length({x}))]) END)"


def _wide(text: str, n: str) -> str:
    one = f"substr({text}, q, 1)"
    return f"coalesce(list_sum([CASE WHEN regexp_matches({one}, '[\\s\\x0B]') THEN 0.35 WHEN regexp_matches({one}, '\\p{{Nd}}') THEN 0.62 WHEN regexp_matches({one}, '[A-Za-z]') THEN 0.58 WHEN regexp_matches({one}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]') THEN 0.36 ELSE 0.75 END::DOUBLE FOR q IN range(1, {n} + 1)]), 0.0)"


def _local(t: str, p: str) -> str:
    """Struct of start and end of p in t."""
    kept = f"[q FOR q IN range(1, length({t}) + 1) IF regexp_matches(substr({t}, q, 1), '[\\p{{L}}\\p{{N}}\\p{{M}}_]')]"
    at = f"instr({_n(t)}, {_n(p)})"
    return f"""CASE WHEN {t} = '' OR {p} = '' THEN NULL WHEN instr({t}, {p}) > 0 THEN {{'s': instr({t}, {p}) - 1, 'e': instr({t}, {p}) - 1 + length({p})}}
      WHEN {_n(p)} <> '' AND {at} > 0 THEN {{'s': ({kept})[{at}] - 1, 'e': ({kept})[{at} + length({_n(p)}) - 1]}} END"""


def _cut(rows: str, name: str) -> str:
    """From rows with unit columns and ``at``: what of the unit it takes, as x, y, w, h, conf, source columns prefixed by p."""
    return f"""(SELECT *, CASE WHEN taken > 0 THEN ((seen + lo) * 8)::DOUBLE WHEN lo <= 0 AND hi >= length(t) THEN x ELSE x + w * {_wide("t", "lo")} / {_wide("t", "length(t)")} END AS px, CASE WHEN taken > 0 THEN (b * 60)::DOUBLE ELSE y END AS py,
      CASE WHEN taken > 0 THEN greatest(1.0, taken * 8) WHEN lo <= 0 AND hi >= length(t) THEN w ELSE greatest(1.0, w * ({_wide("t", "hi")} - {_wide("t", "lo")}) / {_wide("t", "length(t)")}) END::DOUBLE AS pw,
      CASE WHEN taken > 0 THEN 16.0 WHEN lo <= 0 AND hi >= length(t) THEN h ELSE greatest(1.0, h) END::DOUBLE AS ph, CASE WHEN taken > 0 OR (lo <= 0 AND hi >= length(t)) THEN conf ELSE greatest(0.01, conf * 0.82) END::DOUBLE AS pc,
      '{name}_' || CASE WHEN taken > 0 THEN 'char_boxes' WHEN lo <= 0 AND hi >= length(t) THEN 'full_block' ELSE 'weighted_estimate' END AS src
    FROM (SELECT *, greatest(0, least(hi, nvis) - lo) AS taken FROM (SELECT *, greatest(lo, 0)::BIGINT AS lo_, greatest(lo + 1, least(length(t), hi_))::BIGINT AS hi FROM (SELECT * EXCLUDE (pos), greatest(0, least(length(t), pos.s)) AS lo, pos.e AS hi_, pos IS NOT NULL AS placed FROM ({rows})))))"""


def _padded(x: str, y: str, w: str, h: str) -> str:
    """The box with its padding, as {'x', 'y', 'w', 'h'}."""
    pad = f"greatest(3.0, least(16.0, {h} * 0.08))"
    return f"{{'x': ({x} - {pad})::DOUBLE, 'y': ({y} - {pad})::DOUBLE, 'w': greatest(1.0, {w} + 2 * {pad})::DOUBLE, 'h': greatest(1.0, {h} + 2 * {pad})::DOUBLE}}"


def _fits(w: str, h: str, text: str) -> str:
    return f"(area <= 0 OR greatest(1.0, {w} * {h}) / area <= CASE WHEN length({_n(text)}) BETWEEN 1 AND 40 THEN 0.08 ELSE 0.2 END)"


def _regions_sql() -> str:
    boxed = "r.box.x AS x, r.box.y AS y, r.box.w AS w, r.box.h AS h"
    score = "CASE WHEN un = '' THEN 0 ELSE CASE WHEN sn = un THEN 1.0 WHEN contains(un, sn) THEN 0.5 ELSE 0 END + least(length(sn), length(un)) / greatest(length(sn), length(un))::DOUBLE + conf - least(greatest(1.0, w * h) / 1000000, 1.0) END"
    like = f"CASE WHEN contains(sn, un) OR contains(un, sn) THEN least(length(sn), length(un)) / greatest(length(sn), length(un))::DOUBLE ELSE len(list_intersect(s2, u2)) / (len(s2) + len(u2) - len(list_intersect(s2, u2)))::DOUBLE END"
    full = lambda how, placed: f"CASE WHEN placed THEN {{'box': {_padded('px', 'py', 'pw', 'ph')}, 'conf': pc, 'source': src}} WHEN {placed} THEN {{'box': {_padded('x', 'y', 'w', 'h')}, 'conf': conf, 'source': '{how}'}} END"
    return f"""WITH {_BLOCKS}, {_UNITS},
g AS (SELECT i, CASE WHEN i % 4 = 0 THEN greatest(max(x + w), 0) * greatest(max(y + h), 0) ELSE 1000.0 * 1400 END AS area FROM k GROUP BY i),
sp0 AS (SELECT i, b * 10 AS id, '' AS text, (b * 50 + 3)::BIGINT AS ss, (b * 90 + 13)::BIGINT AS se FROM c UNION ALL SELECT i, b * 10 + 1, lower(substr(text, 10, 25)), NULL, NULL FROM c
  UNION ALL SELECT i, b * 10 + 2, substr(text, 1, 30) || substr(text, 45), NULL, NULL FROM c UNION ALL SELECT i, b * 10 + 3, CASE WHEN b = 0 THEN lower(concat_ws('-', string_split(text, ' ')[3], string_split(text, ' ')[4])) ELSE '' END, NULL, NULL FROM c
  UNION ALL SELECT i, b * 10 + 4, 'zzzz qqqq', NULL, NULL FROM c),
sp AS (SELECT *, {_n("text")} AS sn FROM sp0), sp2 AS (SELECT *, {_two("sn")} AS s2 FROM sp),
n0 AS (SELECT i, trim(concat_ws(' ', string_split(text, ' ')[3], string_split(text, ' ')[4]), E' \\t\\n\\r') AS t, 5.0::DOUBLE AS x, (i % 50)::DOUBLE AS y, 90.0::DOUBLE AS w, 18.0::DOUBLE AS h, 0.9::DOUBLE AS conf, 0 AS b, 0 AS nvis, 0 AS seen FROM c WHERE b = 0),
n AS (SELECT *, {_n("t")} AS un FROM n0), n2 AS (SELECT *, {_two("un")} AS u2 FROM n WHERE un <> ''),
m1 AS (SELECT *, {like} AS likeness, contains(sn, un) OR contains(un, sn) AS held FROM (SELECT sp2.*, n2.* EXCLUDE (i) FROM sp2 JOIN n2 ON sp2.i = n2.i WHERE sn <> '')),
a1 AS (SELECT *, {_local("t", "text")} AS pos FROM m1 WHERE held OR likeness >= 0.72),
r1 AS (SELECT i, id, 1 AS stage, r FROM (SELECT i, id, {full("spotting_full_instance", "contains(un, sn)")} AS r FROM {_cut("FROM a1", "spotting")}) WHERE r IS NOT NULL),
o2 AS (SELECT * FROM sp2 WHERE (i, id) NOT IN (SELECT (i, id) FROM r1) AND ss IS NOT NULL),
j2 AS (SELECT o2.i, id, text, u.* EXCLUDE (i, s, e), u.s AS us, {{'s': greatest(ss, u.s) - u.s, 'e': least(se, u.e) - u.s}} AS pos FROM (SELECT * EXCLUDE (se), CASE WHEN se >= ss THEN se ELSE ss + 1 END AS se FROM o2) o2 JOIN u ON o2.i = u.i AND greatest(ss, u.s) < least(se, u.e)),
w2 AS (SELECT i, id, count(*) AS n, avg(conf) AS c, min(x) AS ux, min(y) AS uy, greatest(1.0, max(x + w) - min(x)) AS uw, greatest(1.0, max(y + h) - min(y)) AS uh, any_value(text) AS text FROM j2 GROUP BY i, id),
r2 AS (SELECT i, id, 2 AS stage, r FROM (SELECT p.i, p.id, CASE WHEN {_fits("greatest(1.0, pw + 2 * greatest(3.0, least(16.0, ph * 0.08)))", "greatest(1.0, ph + 2 * greatest(3.0, least(16.0, ph * 0.08)))", "CASE WHEN p.text = '' THEN t ELSE p.text END")} OR NOT (lo <= 0 AND hi >= length(t))
    THEN {{'box': {_padded("px", "py", "pw", "ph")}, 'conf': pc, 'source': src}} END AS r FROM {_cut("FROM j2", "char_span")} p JOIN w2 ON p.i = w2.i AND p.id = w2.id JOIN g ON p.i = g.i WHERE n = 1
  UNION ALL SELECT w2.i, id, CASE WHEN {_fits("uw", "uh", "text")} THEN {{'box': {_padded("ux", "uy", "uw", "uh")}, 'conf': c, 'source': 'char_span_multi_block_union'}} END FROM w2 JOIN g ON w2.i = g.i WHERE n > 1) WHERE r IS NOT NULL),
kb AS (SELECT i, b, text AS t, x, y, w, h, conf, nvis, 0 AS seen, {_n("text")} AS un FROM k), kb2 AS (SELECT *, {_two("un")} AS u2 FROM kb),
o3 AS (SELECT * FROM sp2 WHERE (i, id) NOT IN (SELECT (i, id) FROM r1 UNION ALL SELECT (i, id) FROM r2) AND sn <> ''),
m3 AS (SELECT *, contains(sn, un) OR contains(un, sn) AS held, CASE WHEN un = '' THEN 0 ELSE {like} END AS likeness FROM (SELECT o3.*, kb2.* EXCLUDE (i), area FROM o3 JOIN kb2 ON o3.i = kb2.i JOIN g ON o3.i = g.i)),
a3 AS (SELECT *, {_local("t", "text")} AS pos FROM m3 WHERE held),
q3 AS (SELECT i, id, b, {score} AS score, CASE WHEN placed THEN CASE WHEN {_fits("greatest(1.0, pw + 2 * greatest(3.0, least(16.0, ph * 0.08)))", "greatest(1.0, ph + 2 * greatest(3.0, least(16.0, ph * 0.08)))", "text")} THEN {{'box': {_padded("px", "py", "pw", "ph")}, 'conf': pc, 'source': src}} END
    WHEN {_fits("w", "h", "text")} THEN {{'box': {_padded("x", "y", "w", "h")}, 'conf': conf, 'source': 'text_match_full_block'}} END AS r FROM {_cut("FROM a3", "text_match")}),
r3 AS (SELECT i, id, 3 AS stage, arg_min(r, {{'s': -score, 'b': b}}) AS r FROM q3 WHERE r IS NOT NULL GROUP BY i, id),
w4 AS (SELECT i, id, count(*) AS n, avg(conf) AS c, min(x) AS ux, min(y) AS uy, max(x + w) - min(x) AS uw, max(y + h) - min(y) AS uh, any_value(text) AS text, any_value(area) AS area FROM m3
  WHERE likeness >= 0.56 AND {_fits("w", "h", "text")} AND (i, id) NOT IN (SELECT (i, id) FROM r3) GROUP BY i, id),
r4 AS (SELECT i, id, CASE WHEN n = 1 THEN 4 ELSE 5 END AS stage, {{'box': {_padded("ux", "uy", "uw", "uh")}, 'conf': c, 'source': CASE WHEN n = 1 THEN 'fuzzy_text_match_full_block' ELSE 'fuzzy_text_match_union' END}} AS r FROM w4 WHERE n = 1 OR {_fits("greatest(1.0, uw)", "greatest(1.0, uh)", "text")}),
z AS (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3 UNION ALL FROM r4)
SELECT i AS image_id, id AS span_id, stage::INTEGER AS stage, r.source AS source, round(r.conf, 6) AS confidence, {", ".join(f"round(r.box.{d}, 6) AS {d}" for d in "xywh")} FROM z"""


@query(_regions_sql())
def span_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages: which of them places each span, and where."""
    r = regions.span_regions(spans(spark, sf_dir), blocks(spark, sf_dir), instances(spark, sf_dir), images(spark, sf_dir))
    return r.select("image_id", "span_id", "stage", "source", F.round("confidence", 6).alias("confidence"), *[F.round(f"box.{d}", 6).alias(d) for d in "xywh"])
