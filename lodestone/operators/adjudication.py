"""Context of documents, heuristic adjudication of fragments, and document assessments, as column expressions and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.tables import merged

# Words that tell a document's type (first type that has one), and that tell education or minors.
TYPES = {
    "student_record": ("education", "student", 0.74, ["学号", "成绩", "班级", "家长", "监护人", "学生档案", "student id", "grade"]),
    "textbook_example": ("education", "mixed", 0.70, ["教材", "例题", "示例", "课本", "textbook", "example"]),
    "news_report": ("public_communication", "mixed", 0.66, ["新闻", "报道", "记者", "news", "reported"]),
    "test_sample": ("training_material", "unknown", 0.62, ["测试", "样例", "mock", "fixture", "test sample"]),
}
EDUCATION = ["学校", "老师", "学生", "课堂", "school", "teacher", "student"]
MINOR = ["未成年人", "儿童", "学生", "minor", "child", "teenager"]
# Risk types that are generalised rather than masked, and that are never kept.
GENERALISED = ("address", "education_record")
STRONG = ("id_card", "bank_card", "phone_number", "email", "student_id", "parent_contact", "secret", "medical_record")
# Entity -> sensitivity, training code; entities that are always S4 and T3.
SENSITIVITY = {"person_name": ("S2", "T1"), "phone_number": ("S3", "T1"), "email": ("S2", "T1"), "social_account": ("S2", "T1"), "address": ("S3", "T1"), "student_id": ("S3", "T1")}
ALWAYS_STRICT = ("id_card", "bank_card", "medical_record", "secret", "combined_identity")


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def document_context(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, document_type, scene_type, subject_type, education, minor, confidence."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    pick = lambda k, other: _first(low, {t: v[k] for t, v in TYPES.items()}, other)
    d = docs.select("doc_id", _first(low, {t: t for t in TYPES}, "other").alias("document_type"), pick(0, "other").alias("scene_type"), pick(1, "unknown").alias("subject"), pick(2, 0.46).alias("confidence"), has_any(low, EDUCATION).alias("e"), has_any(low, MINOR).alias("m"))
    education = (F.col("scene_type") == "education") | F.col("e")
    minor = F.col("subject").isin("student", "minor") | F.col("m")
    subject = F.when(minor & (F.col("subject") == "unknown"), "minor").otherwise(F.col("subject"))
    return d.select("doc_id", "document_type", "scene_type", subject.alias("subject_type"), education.alias("education"), minor.alias("minor"), "confidence")


def _first(low: Column, values: dict, other) -> Column:
    out = None
    for t, v in values.items():
        hit = has_any(low, TYPES[t][3])
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out.otherwise(F.lit(other))


def content_fragments(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Role, action and eligibility of each content finding in its document's context."""
    f = merged(findings, context.select("doc_id", "document_type", "minor"), "doc_id", "left")
    severe, t = F.col("severity").isin("high", "critical"), F.col("document_type")
    shielded = F.coalesce(t.isin("textbook_example", "news_report"), F.lit(False))
    role = F.when(shielded, F.when(t == "textbook_example", "teaching").otherwise("discussion")).when(F.col("needs_adjudication"), "uncertain").otherwise("propagating_risk")
    action = F.when(shielded, "restricted_review").when(F.col("needs_adjudication") | ~severe, "manual_review").otherwise("reject")
    out = f.withColumn("role", role).withColumn("action", action).withColumn("protective", shielded)
    return out.withColumn("eligibility", F.when(F.col("action") == "reject", "blocked").otherwise("restricted")).withColumn("confidence", F.greatest(F.lit(0.45), F.col("confidence"))).drop("document_type", "minor")


def privacy_fragments(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Truth and action of each privacy finding; strong kinds, and names in records of students or minors, are never kept."""
    f = merged(findings, context.select("doc_id", "document_type", "minor"), "doc_id", "left")
    risk, t = F.col("risk_type"), F.coalesce("document_type", F.lit("other"))
    floor = risk.isin(*STRONG, "combined_identity") | ((risk == "person_name") & ((t == "student_record") | F.coalesce("minor", F.lit(False))))
    cautious = F.when(risk == "combined_identity", "manual_review").when(risk.isin(*GENERALISED), "generalize").otherwise("redact")
    example = (t == "textbook_example") & (risk == "person_name")
    plain = F.when(risk == "combined_identity", "manual_review").when(example, "manual_review").when((t == "student_record") & risk.isin(*GENERALISED), "generalize").otherwise("redact")
    truth = F.when(floor, F.when(risk == "combined_identity", "uncertain").otherwise("real_pii")).when(example, "contextual_example").otherwise("real_pii")
    return f.withColumn("truth", truth).withColumn("action", F.when(floor, cautious).otherwise(plain)).drop("document_type", "minor")


def content_assessment(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """recommended, operational_risk, training of each document, from its fragments."""
    a = fragments.groupBy("doc_id").agg(F.bool_or(F.col("action") == "reject").alias("r"), F.bool_or((F.col("action") == "manual_review") | F.col("protective")).alias("m"))
    j = merged(docs.select("doc_id"), a, "doc_id", "left")
    rec = F.when(F.col("r").isNull(), "keep").when(F.col("r"), "reject").when(F.col("m"), "manual_review").otherwise("restricted_review")
    j = j.withColumn("recommended", rec)
    risk = F.when(F.col("recommended") == "keep", "low").when(F.col("recommended") == "reject", "high").otherwise("medium")
    training = F.when(F.col("recommended") == "keep", "allowed").when(F.col("recommended") == "reject", "blocked").otherwise("restricted")
    return j.select("doc_id", "recommended", risk.alias("operational_risk"), training.alias("training"))


def privacy_assessment(docs: DataFrame, fragments: DataFrame, context: DataFrame) -> DataFrame:
    """recommended, risk_level, training of each document, from its fragments."""
    has = lambda v: F.bool_or(F.col("action") == v)
    a = fragments.groupBy("doc_id").agg(F.bool_or(F.col("risk_type") == "combined_identity").alias("c"), has("exclude_from_training").alias("x"), has("manual_review").alias("m"), has("generalize").alias("g"))
    j = merged(merged(docs.select("doc_id"), a, "doc_id", "left"), context.select("doc_id", "minor"), "doc_id", "left")
    rec = F.when(F.col("c").isNull(), "keep").when(F.col("c") | F.col("x"), "exclude_from_training").when(F.col("m"), "manual_review").when(F.col("g"), "generalize").otherwise("redact")
    j = j.withColumn("recommended", rec)
    r = F.col("recommended")
    level = F.when(r == "keep", "low").when(r == "exclude_from_training", "high").when(r.isin("manual_review", "generalize"), "medium").when(F.col("minor"), "medium").otherwise("low")
    j = j.withColumn("risk_level", level)
    training = F.when(r == "keep", "allowed").when(r == "exclude_from_training", "blocked").when(F.col("risk_level") == "medium", "restricted").otherwise("allowed")
    return j.select("doc_id", "recommended", "risk_level", training.alias("training"))


def privacy_rule_hits(findings: DataFrame) -> DataFrame:
    """Sensitivity and training code of each finding by the catalog; some kinds are always the strictest."""
    risk = F.col("risk_type")
    s, t = F.lit("S2"), F.lit("T1")
    for k, (a, b) in SENSITIVITY.items():
        s, t = F.when(risk == k, a).otherwise(s), F.when(risk == k, b).otherwise(t)
    strict = risk.isin(*ALWAYS_STRICT)
    return findings.withColumn("sensitivity", F.when(strict, "S4").otherwise(s)).withColumn("training", F.when(strict, "T3").otherwise(t))


def negative_summary(text: Column) -> Column:
    """Whether a text only says that nothing personal was found."""
    low = F.lower(F.trim(text))
    return low.rlike("(no|without|未|没有|不含)[^.。]{0,12}(pii|personal|sensitive|个人|隐私|敏感)") & ~low.rlike("(but|however|但|然而)")
