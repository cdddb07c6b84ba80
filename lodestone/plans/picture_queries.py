"""Picture operators: line items stand for findings of an order's picture; boxes come from integer arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import picture
from lodestone.queries import query, table

W, H = 400.0, 300.0
_KINDS = [("vision_object", "face"), ("vision_object", "license_plate"), ("text_pii", "phone_number"), ("safety", "explicit"), ("vision_object", "other"), ("text_content", "advert"), ("vision_object", "badge"), ("text_pii", "organization"), ("vision_object", "qr_code"), ("vision_object", "id_card"), ("safety", "self_harm")]
_F = f"""SELECT l_orderkey AS image_id, l_orderkey * 10 + l_linenumber AS id, {[k for _, k in _KINDS]}[l_partkey % 11 + 1] AS category, {[t for t, _ in _KINDS]}[l_partkey % 11 + 1] AS finding_type, (l_partkey % 100) / 100.0::DOUBLE AS score,
  (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 150)::DOUBLE AS y, (40 + l_partkey % 60)::DOUBLE AS w, (30 + l_suppkey % 50)::DOUBLE AS h, l_partkey % 17 = 3 AS lost, l_suppkey % 5 = 0 AS redact_only FROM lineitem"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _KINDS]), (p % 11 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), pick(1).alias("category"), pick(0).alias("finding_type"),
        ((p % 100) / 100.0).alias("score"), g.box(p % 200, s % 150, 40 + p % 60, 30 + s % 50).alias("box"), (p % 17 == 3).alias("localization_required"), (s % 5 == 0).alias("redact_only"),
    )


_IOU = f"""WITH f AS ({_F}), j AS (SELECT a.image_id, a.id, b.id AS other, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS o, a.w * a.h AS sa, b.w * b.h AS sb
  FROM f a JOIN f b ON a.image_id = b.image_id AND a.id < b.id) """


@query(_IOU + "SELECT image_id, id, other, round(o / (sa + sb - o), 9) AS iou, round(o / least(sa, sb), 9) AS containment FROM j WHERE o / (sa + sb - o) > 0.05 OR o / least(sa, sb) >= 0.75")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return picture.near_boxes(f, f).withColumns({c: F.round(c, 9) for c in ("iou", "containment")})


@query()
def finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picture.merged(findings(spark, sf_dir)).select("image_id", "place", "id", "category", "score")


@query(f"""SELECT id, mode, round(x0, 6) AS x0, round(y0, 6) AS y0, round(w0, 6) AS w0, round(h0, 6) AS h0 FROM (SELECT id, CASE category WHEN 'face' THEN 'gaussian_blur' WHEN 'badge' THEN 'pixelate' ELSE 'black_box' END AS mode,
  CASE category WHEN 'face' THEN x + w * 0.18::DOUBLE WHEN 'license_plate' THEN x + w * 0.12::DOUBLE WHEN 'badge' THEN x + w * 0.08::DOUBLE WHEN 'id_card' THEN x + w * 0.08::DOUBLE WHEN 'qr_code' THEN x - greatest(4, w * 0.05::DOUBLE) ELSE x END AS x0,
  CASE category WHEN 'face' THEN y + h * 0.22::DOUBLE WHEN 'license_plate' THEN y + h * 0.22::DOUBLE WHEN 'badge' THEN y + h * 0.25::DOUBLE WHEN 'id_card' THEN y + h * 0.28::DOUBLE WHEN 'qr_code' THEN y - greatest(4, h * 0.05::DOUBLE) ELSE y END AS y0,
  CASE category WHEN 'face' THEN w * 0.64::DOUBLE WHEN 'license_plate' THEN w * 0.76::DOUBLE WHEN 'badge' THEN w * 0.84::DOUBLE WHEN 'id_card' THEN w * 0.84::DOUBLE WHEN 'qr_code' THEN w + 2 * greatest(4, w * 0.05::DOUBLE) ELSE w END AS w0,
  CASE category WHEN 'face' THEN h * 0.38::DOUBLE WHEN 'license_plate' THEN h * 0.56::DOUBLE WHEN 'badge' THEN h * 0.55::DOUBLE WHEN 'id_card' THEN h * 0.48::DOUBLE WHEN 'qr_code' THEN h + 2 * greatest(4, h * 0.05::DOUBLE) ELSE h END AS h0 FROM ({_F}))""")
def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = picture.redaction_plan(findings(spark, sf_dir))
    return r.select("id", "mode", *[F.round(f"box.{c}", 6).alias(f"{c}0") for c in "xywh"])


_POLICY = f"""WITH f AS (SELECT image_id, category, finding_type, score, lost AND id % 2 = 0 AS lost, redact_only, id % 2 = 0 AND lost AS nobox FROM ({_F})),
k AS (SELECT *, finding_type = 'vision_object' AND category IN ('face', 'id_card', 'badge', 'qr_code', 'license_plate') AND nobox AND lost AS unlocated FROM f),
a AS (SELECT image_id, coalesce(bool_or(unlocated OR (finding_type = 'safety' AND NOT redact_only AND score >= 0.7)) FILTER (score >= 0.5), false) AS d,
  coalesce(bool_or((finding_type = 'text_pii' AND category = 'phone_number') OR (finding_type = 'vision_object' AND category IN ('face', 'id_card', 'badge', 'qr_code', 'license_plate') AND NOT unlocated) OR (finding_type = 'safety' AND redact_only)) FILTER (score >= 0.5), false) AS hide,
  coalesce(bool_or(unlocated OR finding_type = 'text_content' OR (finding_type = 'safety' AND NOT redact_only) OR (finding_type = 'vision_object' AND category IN ('face', 'badge', 'qr_code'))) FILTER (score >= 0.5), false) AS l,
  bool_or(category IN ('face', 'badge', 'qr_code')) AS m,
  coalesce(string_agg(DISTINCT CASE WHEN finding_type = 'text_pii' AND category = 'phone_number' THEN 'PII_PHONE_NUMBER' WHEN unlocated THEN 'VISION_UNLOCALIZED_' || upper(category) WHEN finding_type = 'vision_object' AND category <> 'other' THEN 'VISION_' || upper(category)
    WHEN finding_type = 'text_content' THEN 'TEXT_CONTENT_' || upper(category) WHEN finding_type = 'safety' THEN 'SAFETY_' || upper(category) END, ',' ORDER BY CASE WHEN finding_type = 'text_pii' AND category = 'phone_number' THEN 'PII_PHONE_NUMBER' WHEN unlocated THEN 'VISION_UNLOCALIZED_' || upper(category) WHEN finding_type = 'vision_object' AND category <> 'other' THEN 'VISION_' || upper(category)
    WHEN finding_type = 'text_content' THEN 'TEXT_CONTENT_' || upper(category) WHEN finding_type = 'safety' THEN 'SAFETY_' || upper(category) END) FILTER (score >= 0.5), '') AS reasons FROM k GROUP BY image_id),
c AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 7 = 0 THEN 'faces' ELSE '' END AS u, o_orderkey % 2 = 0 AS re, o_orderkey % 3 = 0 AS au, o_orderkey % 5 <> 0 AS ed, o_orderkey % 11 <> 0 AS ord FROM orders),
x AS (SELECT c.*, coalesce(d, false) AS d, coalesce(hide, false) AS hide, coalesce(l, false) AS l, coalesce(m, false) AS m, coalesce(reasons, '') AS reasons FROM c LEFT JOIN a USING (image_id)),
y AS (SELECT *, CASE WHEN d THEN 'do_not_deliver' WHEN u <> '' THEN CASE WHEN re AND au THEN 'deliver_raw_restricted' ELSE 'do_not_deliver' END WHEN NOT ed THEN 'do_not_deliver'
  WHEN hide THEN CASE WHEN l OR m THEN 'deliver_redacted_with_constraints' ELSE 'deliver_redacted' END WHEN NOT ord AND re THEN 'deliver_raw_restricted' ELSE 'deliver_raw' END AS dataset_action FROM x)
SELECT image_id, CASE WHEN dataset_action = 'do_not_deliver' THEN 'drop' WHEN starts_with(dataset_action, 'deliver_redacted') THEN 'pass_redacted' ELSE 'pass_raw' END AS decision, dataset_action, l OR (NOT d AND u = '' AND NOT ed) AS review_required, reasons FROM y"""


@query(_POLICY)
def picture_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    context = table(spark, sf_dir, "orders").select(
        k.alias("image_id"), F.when(k % 7 == 0, "faces").otherwise("").alias("restricted_use_case"), (k % 2 == 0).alias("restricted_enabled"), (k % 3 == 0).alias("authorized"), (k % 5 != 0).alias("education_value"), (k % 11 != 0).alias("ordinary_enabled"),
    )
    f = findings(spark, sf_dir).withColumn("localization_required", F.col("localization_required") & (F.col("id") % 2 == 0))
    return picture.policy(f.withColumn("box", F.when(~F.col("localization_required"), F.col("box"))), context)


@query(f"""SELECT image_id, s AS hidden_share, s <= 0.45 AS education_value FROM (SELECT image_id, round(sum(w * h) / {W * H}, 6)::DOUBLE AS s FROM ({_F}) WHERE finding_type = 'text_pii' GROUP BY image_id)""")
def education_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picture.education_value(picture.redaction_plan(findings(spark, sf_dir).filter("finding_type = 'text_pii'")), W, H)


@query(f"SELECT image_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS boxes, round(avg(score), 9) AS confidence FROM ({_F}) GROUP BY image_id")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picture.union_box(findings(spark, sf_dir), "image_id").withColumn("confidence", F.round("confidence", 9))


@query(f"SELECT image_id, id, category FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, id) AS r FROM ({_F})) WHERE r <= CASE category WHEN 'explicit' THEN 2 ELSE 1 END")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picture.top_per_category(findings(spark, sf_dir), {"explicit": 2}, 1).select("image_id", "id", "category")


@query("""WITH l AS (SELECT doc_id AS image_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
SELECT image_id, line::INTEGER AS line, coalesce(sum(length(t) + 1) OVER (PARTITION BY image_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(t)::INTEGER AS n FROM l WHERE t <> ''""")
def ocr_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for recognised pages of one block."""
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.lit(0).alias("block_id"), "text")
    return picture.ocr_text(blocks).select("image_id", "line", "start", F.length("t").alias("n"))


@query("SELECT conv_id AS image_id, count(*) AS blocks, round(avg(length(text) % 100), 4) AS confidence, sum(length(text))::BIGINT AS text_length FROM conversations GROUP BY conv_id")
def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), "text", (F.length("text") % 100).alias("confidence"))
    return picture.ocr_summary(c)


_WIDE = lambda t: f"(0.35 * len(regexp_extract_all({t}, ' ')) + 0.62 * len(regexp_extract_all({t}, '[0-9]')) + 0.58 * len(regexp_extract_all({t}, '[A-Za-z]')) + 0.36 * len(regexp_extract_all({t}, '[^ 0-9A-Za-z_]')) + 0.75 * len(regexp_extract_all({t}, '_')))::DOUBLE"


@query(f"""SELECT p_partkey, round(10 + 100 * {_WIDE("left(p_name, 3)")} / t, 6) AS x, round(greatest(1, 100 * {_WIDE("substr(p_name, 4, 5)")} / t), 6) AS w FROM (SELECT *, {_WIDE("p_name")} AS t FROM part)""")
def ocr_char_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = g.box(F.lit(10), F.lit(0), F.lit(100), F.lit(12))
    b = picture.char_box(line, F.col("p_name"), F.lit(3), F.lit(8))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(b["x"], 6).alias("x"), F.round(b["w"], 6).alias("w"))


@query("""SELECT l_orderkey AS image_id, l_linenumber AS n, CASE WHEN a < 0.6 OR a > 1.8 OR c < 40 THEN 'document' WHEN c > 70 THEN 'photo' ELSE 'mixed' END AS route
FROM (SELECT *, (40 + l_partkey % 60) / (30 + l_suppkey % 50)::DOUBLE AS a, l_quantity * 2 AS c FROM lineitem)""")
def route_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = picture.route(40 + F.col("l_partkey") % 60, (30 + F.col("l_suppkey") % 50).cast("double"), F.col("l_quantity") * 2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("n"), r.alias("route"))
