"""Recall by layout: customers stand for lines of recognised text, forty to a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import layout
from lodestone.queries import query, table

_TEXTS = ["{k} Main Street", "Apt {k}", "Springfield, IL 62704", "张三丰", "{k}级3班 联系电话", "王 小明", "Seller: x", "plain words", "DPO AE 09012", "PO Box {k}", "护理", "12 Long Road, TX 7501", "护理组", "mail a@b.co"]


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line k: one of the texts by a stride that makes runs of address lines, in one of two columns."""
    k = F.col("c_custkey")
    n = ((k * k + F.floor(k / 7)) % 14).cast("int")
    text = F.replace(F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), n + 1), F.lit("{k}"), k.cast("string"))
    box = g.box(F.when(k % 11 == 0, 400).otherwise(20 + k % 5), k % 40 * F.when(k % 13 == 0, 90).otherwise(25), 150 + k % 60, F.lit(20))
    c = table(spark, sf_dir, "customer").select(F.floor(k / 40).alias("image_id"), F.format_string("line_%06d", k).alias("unit"), text.alias("text"), (k % 40 * 100).alias("start"), (k % 40 * 100 + F.length(text)).alias("end"), box.alias("box"), (k % 100 / 100.0).cast("double").alias("confidence"))
    return c


_U = f"""u AS (SELECT c_custkey // 40 AS image_id, printf('line_%06d', c_custkey) AS unit, replace({_TEXTS}[(c_custkey * c_custkey + c_custkey // 7) % 14 + 1], '{{k}}', c_custkey::VARCHAR) AS text, c_custkey % 40 * 100 AS s, c_custkey AS k,
  CASE WHEN c_custkey % 11 = 0 THEN 400 ELSE 20 + c_custkey % 5 END::DOUBLE AS x, (c_custkey % 40 * CASE WHEN c_custkey % 13 = 0 THEN 90 ELSE 25 END)::DOUBLE AS y, (150 + c_custkey % 60)::DOUBLE AS w, 20.0::DOUBLE AS h, (c_custkey % 100 / 100.0)::DOUBLE AS c FROM customer)"""
_SIGN = " OR ".join(f"regexp_matches(near, '(?i){s}')" for s in layout.SIGNS)
_PAD = "greatest(3.0, least(16.0, {h} * 0.08))"


@query(f"""WITH {_U}, n AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS name, concat_ws(chr(10), lag(text, 2) OVER v, lag(text, 1) OVER v, lead(text, 1) OVER v, lead(text, 2) OVER v, lead(text, 3) OVER v) AS near FROM u WINDOW v AS (PARTITION BY image_id ORDER BY s))
SELECT image_id, unit, name AS text, s AS start, round(x - {_PAD.format(h="h")}, 6) AS x, 'person_name' AS category, 0.68::DOUBLE AS score FROM n WHERE regexp_full_match(name, '[\\x{{4e00}}-\\x{{9fa5}}·]{{2,4}}') AND name NOT IN {layout.NO_NAMES}
  AND NOT ({" OR ".join(f"contains(name, '{x}')" for x in layout.NOT_IN_NAMES)}) AND ({_SIGN})""")
def isolated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.isolated_names(units(spark, sf_dir)).select("image_id", "unit", "text", "start", F.round("box.x", 6).alias("x"), "category", "score")


_ADDR = " OR ".join(f"regexp_matches(trim(text), '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in layout.ADDRESS)


def _column(a: str, b: str) -> str:
    return f"""((abs({a}x - {b}x) <= greatest(80.0, least({a}w, {b}w) * 0.35) OR greatest(0.0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) / greatest(1.0, least({a}w, {b}w)) >= 0.45)
      AND greatest({b}y - {a}y - {a}h, {a}y - {b}y - {b}h, 0.0) <= greatest(60.0, greatest({a}h, {b}h) * 1.5))"""


_LINES = f"""{_U}, a AS (SELECT *, length(trim(text)) BETWEEN 1 AND 100 AND NOT regexp_matches(lower(trim(text)), '{layout.STOP}') AND ({_ADDR}) AS addr FROM u)"""
_BOX = "count(*) AS n, min(s) AS start, avg(c) AS confidence, min(x) AS x0, min(y) AS y0, max(x + w) - min(x) AS w0, max(y + h) - min(y) AS h0"


@query(f"""WITH {_LINES}, b AS (SELECT *, lag(addr) OVER v AS pa, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(w) OVER v AS pw, lag(h) OVER v AS ph FROM a WINDOW v AS (PARTITION BY image_id ORDER BY s)),
i AS (SELECT *, sum(CASE WHEN addr AND (NOT coalesce(pa, false) OR NOT {_column("p", "").replace("p.", "p")}) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY s)::BIGINT AS grp FROM b),
j AS (SELECT image_id, grp, string_agg(text, ' ' ORDER BY s) AS t, string_agg(trim(text), chr(10) ORDER BY s) AS text, string_agg(unit, ',' ORDER BY s) AS units, {_BOX} FROM i WHERE addr GROUP BY image_id, grp),
q AS (SELECT *, regexp_matches(t, '{layout.NUMBER}')::INT + regexp_matches(t, '(?i){layout.PLACE}')::INT + regexp_matches(t, '{layout.CODE}')::INT + contains(t, ',')::INT AS score FROM j)
SELECT image_id, grp, text, start, units, score, round(confidence, 6) AS confidence, round(y0 - {_PAD.format(h="h0")}, 6) AS y, round(h0 + 2 * {_PAD.format(h="h0")}, 6) AS h FROM q WHERE score >= 2""")
def address_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = layout.address_groups(units(spark, sf_dir))
    return a.select("image_id", "grp", "text", "start", "units", "score", F.round("confidence", 6).alias("confidence"), F.round("box.y", 6).alias("y"), F.round("box.h", 6).alias("h"))


# Spans from the third line of each picture on: of every fifth line to a few characters into the next but one.
_SPANS = "SELECT c_custkey // 40 AS image_id, c_custkey AS span_id, c_custkey % 40 * 100 + 2 AS ss, c_custkey % 40 * 100 + CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 203 END AS se FROM customer WHERE c_custkey % 5 = 0"


@query(f"""WITH RECURSIVE {_LINES}, sp AS ({_SPANS}), an AS (SELECT sp.image_id, span_id, k, x, y, w, h, addr FROM sp JOIN a ON sp.image_id = a.image_id AND greatest(ss, s) < least(se, s + length(text))),
g AS (SELECT image_id, span_id, k AS at_k, d, k + d AS k, x, y, w, h FROM an, (SELECT unnest([-1, 1]) AS d)
  UNION ALL SELECT g.image_id, span_id, at_k, d, g.k + d, g.x, g.y, g.w, g.h FROM g JOIN a ON g.k = a.k AND g.image_id = a.image_id AND a.addr AND {_column("g.", "a.")}),
got AS (SELECT image_id, span_id, k FROM an WHERE addr UNION SELECT g.image_id, span_id, g.k FROM g JOIN a ON g.k = a.k AND g.image_id = a.image_id AND a.addr AND {_column("g.", "a.")}),
j AS (SELECT got.image_id, span_id, string_agg(unit, ',' ORDER BY s) AS units, {_BOX} FROM got JOIN a ON got.k = a.k GROUP BY got.image_id, span_id)
SELECT image_id, span_id, units, start, round(confidence, 6) AS confidence, round(y0 - {_PAD.format(h="h0")}, 6) AS y, round(h0 + 2 * {_PAD.format(h="h0")}, 6) AS h FROM j""")
def expanded_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    spans = table(spark, sf_dir, "customer").filter(k % 5 == 0).select(F.floor(k / 40).alias("image_id"), k.alias("span_id"), (k % 40 * 100 + 2).alias("start"), (k % 40 * 100 + F.when(k % 2 == 0, 4).otherwise(203)).alias("end"))
    e = layout.expanded_addresses(spans, units(spark, sf_dir))
    return e.select("image_id", "span_id", "units", "start", F.round("confidence", 6).alias("confidence"), F.round("box.y", 6).alias("y"), F.round("box.h", 6).alias("h"))
