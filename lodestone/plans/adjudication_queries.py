"""Adjudication and post-model vision operators on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import adjudication, vision
from lodestone.plans.picture_queries import findings
from lodestone.plans.picture_queries import _F as _FINDINGS
from lodestone.queries import query, table

_HAS = {t: " OR ".join(f"contains(l, '{w}')" for w in v[3]) for t, v in adjudication.TYPES.items()}
_ANY = lambda ws: "(" + " OR ".join(f"contains(l, '{w}')" for w in ws) + ")"
_CASE = lambda k, other: "CASE " + " ".join(f"WHEN {_HAS[t]} THEN {v[k]!r}" for t, v in adjudication.TYPES.items()) + f" ELSE {other!r} END"
_CTX = f"""SELECT doc_id, CASE {" ".join(f"WHEN {h} THEN '{t}'" for t, h in _HAS.items())} ELSE 'other' END AS document_type, {_CASE(0, "other")} AS scene_type, {_CASE(1, "unknown")} AS s,
  {_CASE(2, 0.46)}::DOUBLE AS confidence, {_ANY(adjudication.EDUCATION)} AS e, {_ANY(adjudication.MINOR)} AS m FROM (SELECT doc_id, lower(text) AS l FROM documents)"""
_CONTEXT = f"SELECT doc_id, document_type, scene_type, CASE WHEN s = 'unknown' AND m THEN 'minor' ELSE s END AS subject_type, scene_type = 'education' OR e AS education, s IN ('student', 'minor') OR m AS minor, confidence FROM ({_CTX})"


@query(_CONTEXT)
def document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudication.document_context(table(spark, sf_dir, "documents"))


# A finding of each labelled document, by integer arithmetic; contexts likewise.
_K = "SELECT doc_id, ['person_name', 'address', 'email', 'combined_identity', 'minor_info'][doc_id % 5 + 1] AS risk_type, ['low', 'medium', 'high', 'critical'][doc_id % 4 + 1] AS severity, doc_id % 7 = 0 AS need, ['student_record', 'textbook_example', 'news_report', 'other'][doc_id % 11 % 4 + 1] AS t, doc_id % 6 = 0 AS minor FROM labels"


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    lab = table(spark, sf_dir, "labels").select("doc_id")
    f = lab.select("doc_id", pick(["person_name", "address", "email", "combined_identity", "minor_info"], d % 5).alias("risk_type"), pick(["low", "medium", "high", "critical"], d % 4).alias("severity"), (d % 7 == 0).alias("needs_adjudication"), F.lit(0.4).alias("confidence"))
    c = lab.select("doc_id", pick(["student_record", "textbook_example", "news_report", "other"], d % 11 % 4).alias("document_type"), (d % 6 == 0).alias("minor"))
    return lab, f, c


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN t IN ('textbook_example', 'news_report') THEN 'restricted_review' WHEN need OR severity IN ('low', 'medium') THEN 'manual_review' ELSE 'reject' END AS action, t IN ('textbook_example', 'news_report') AS p FROM ({_K}))
SELECT doc_id, CASE WHEN action = 'reject' THEN 'reject' ELSE 'manual_review' END AS recommended, CASE WHEN action = 'reject' THEN 'high' ELSE 'medium' END AS operational_risk, CASE WHEN action = 'reject' THEN 'blocked' ELSE 'restricted' END AS training FROM f""")
def content_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, f, c = _labelled(spark, sf_dir)
    return adjudication.content_assessment(lab, adjudication.content_fragments(f, c))


@query(f"""WITH f AS (SELECT *, CASE WHEN risk_type IN ('email', 'combined_identity') OR risk_type = 'person_name' AND (t = 'student_record' OR minor) THEN CASE risk_type WHEN 'combined_identity' THEN 'manual_review' ELSE 'redact' END
  WHEN t = 'textbook_example' AND risk_type = 'person_name' THEN 'manual_review' WHEN t = 'student_record' AND risk_type = 'address' THEN 'generalize' ELSE 'redact' END AS action FROM ({_K})),
r AS (SELECT *, CASE WHEN risk_type = 'combined_identity' THEN 'exclude_from_training' ELSE action END AS rec FROM f),
l AS (SELECT *, CASE WHEN rec = 'exclude_from_training' THEN 'high' WHEN rec IN ('manual_review', 'generalize') OR minor THEN 'medium' ELSE 'low' END AS lev FROM r)
SELECT doc_id, rec AS recommended, lev AS risk_level, CASE WHEN lev = 'high' THEN 'blocked' WHEN lev = 'medium' THEN 'restricted' ELSE 'allowed' END AS training FROM l""")
def privacy_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, f, c = _labelled(spark, sf_dir)
    return adjudication.privacy_assessment(lab, adjudication.privacy_fragments(f, c), c)


@query(f"SELECT doc_id, risk_type, CASE risk_type WHEN 'combined_identity' THEN 'S4' WHEN 'address' THEN 'S3' ELSE 'S2' END AS sensitivity, CASE risk_type WHEN 'combined_identity' THEN 'T3' ELSE 'T1' END AS training FROM ({_K})")
def privacy_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudication.privacy_rule_hits(_labelled(spark, sf_dir)[1]).select("doc_id", "risk_type", "sensitivity", "training")


@query()
def box_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.box_dedup(findings(spark, sf_dir)).select("image_id", "id", "category", "score")


@query(f"""SELECT id, reasons, reasons = '' AS identifiable, round(least(0.99, score * CASE WHEN reasons = '' THEN 1 ELSE 0.45 END), 4) AS confidence FROM (SELECT *, concat_ws(',', CASE WHEN least(w, h) < 24 THEN 'small' END, CASE WHEN w * h / 120000 < 0.0003 THEN 'tiny_share' END,
  CASE WHEN w / h < 0.55 OR w / h > 1.8 THEN 'aspect' END, CASE WHEN least(w, h) / greatest(w, h) < 0.42 THEN 'narrow' END,
  CASE WHEN ((x <= greatest(2, w * 0.08) OR x + w >= 400 - greatest(2, w * 0.08)) AND w < 48) OR ((y <= greatest(2, h * 0.08) OR y + h >= 300 - greatest(2, h * 0.08)) AND h < 48) THEN 'clipped' END,
  CASE WHEN (id % 5) < 3 THEN 'few_points' END, CASE WHEN score < 0.45 THEN 'low_score' END) AS reasons FROM ({_FINDINGS}) WHERE category = 'face')""")
def face_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points at a face's centre, id mod 5 of them, and one far off."""
    b = F.col("box")
    centre = F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"))
    points = F.concat(F.array_repeat(centre, (F.col("id") % 5).cast("int")), F.array(F.struct(F.lit(9999.0).alias("x"), F.lit(9999.0).alias("y"))))
    f = findings(spark, sf_dir).filter("category = 'face'").withColumn("points", points).withColumn("width", F.lit(400.0)).withColumn("height", F.lit(300.0))
    return vision.identifiability(f).select("id", "reasons", "identifiable", "confidence")
