"""Recall of personal data: a rule pack run by one kernel, then relational post-processing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import kernels
from lodestone.ranks import SEVERITY_WEIGHT, lookup
from lodestone.tables import merged

_DIGITS = "零〇○洞Oo幺一二两三四五六七八九0-9"
_SUBJECTS = "语文|数学|英语|物理|化学|生物|历史|地理|政治"
# Rule -> (risk type, severity, replacement, case-insensitive, pattern with its value in group 1).
RULES = {
    "person_name_cn": ("person_name", "medium", "<NAME>", False, r"(?:姓名|学生姓名|家长姓名|监护人姓名|班主任姓名)[:：\s]{1,3}([一-龥·]{2,4})"),
    "person_name_en": ("person_name", "medium", "<NAME>", True, r"(?:Name|Student|Parent|Guardian)[:：\s]{0,3}([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,1})"),
    "student_name_context_cn": ("person_name", "medium", "<NAME>", False, r"(?:学生|同学)([一-龥·]{2,4})(?=由|本学期|同学|，|。|\s)"),
    "teacher_name_context_cn": ("person_name", "medium", "<NAME>", False, r"班主任([一-龥·]{2,4})(?=负责|老师|，|。|\s)"),
    "guardian_name_context_cn": ("person_name", "medium", "<NAME>", False, r"(?:监护人|开户名|妈妈叫|父亲叫|母亲叫)([一-龥·]{2,4})(?=，|。|\s)"),
    "email": ("email", "high", "<EMAIL>", False, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
    "phone_cn": ("phone_number", "high", "<PHONE>", False, r"((?:\+?86[-\s]?)?1[3-9]\d{9})"),
    "phone_spoken_cn": ("phone_number", "high", "<PHONE>", True, rf"(?:手机号|电话|联系电话|联系方式|家长电话)[^，。；;\n]{{0,12}}?([{_DIGITS}\s\-—_杠]{{11,28}})"),
    "phone_generic": ("phone_number", "medium", "<PHONE>", False, r"((?:\+?\d{1,3}[-\s])?(?:\(?0\d{2,3}\)?[-\s]?)\d{7,8})"),
    "phone_context_generic": ("phone_number", "medium", "<PHONE>", True, r"(?:phone|tel|telephone|mobile|联系电话|联系方式|电话)[:：\s]{0,8}((?:\+?\d[\d\s().-]{7,}\d))"),
    "id_card_cn": ("id_card", "critical", "<ID_CARD>", False, r"([1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])"),
    "id_card_spoken_cn": ("id_card", "critical", "<ID_CARD>", True, rf"(?:身份证号|身份证)[^，。；;\n]{{0,18}}?([{_DIGITS}Xx\s\-—_杠]{{15,40}})"),
    "passport": ("id_card", "high", "<ID_CARD>", True, r"(?:护照|passport)[:：\s]{0,3}([A-Z][0-9A-Z]{6,10})"),
    "bank_card": ("bank_card", "high", "<BANK_CARD>", False, r"((?:(?:62|[4569])\d[ -]?)(?:\d[ -]?){14,17})"),
    "student_id": ("student_id", "high", "<STUDENT_ID>", True, r"(?:学号|学生编号|student[_\s-]?id)[:：\s]{0,3}([A-Za-z0-9-]{4,20})"),
    "student_id_spoken_cn": ("student_id", "medium", "<STUDENT_ID>", True, rf"(?:学号|学生编号|准考证号)[^，。；;\n]{{0,12}}?([A-Za-z]?[{_DIGITS}\s\-—_杠]{{5,30}})"),
    "parent_contact": ("parent_contact", "high", "<PARENT_CONTACT>", True, r"(?:家长(?:联系电话|电话|联系方式)|Parent(?:\s+Contact|\s+Phone)?)[:：\s]{0,3}([+0-9A-Za-z@._ -]{5,40})"),
    "social_account": ("social_account", "medium", "<SOCIAL_ACCOUNT>", True, r"(?:微信|微信号|QQ|钉钉|社交账号|social\s+account)[:：\s]{0,3}([A-Za-z][A-Za-z0-9_-]{4,19}|[1-9]\d{5,11})"),
    "payment_account": ("payment_account", "high", "<PAYMENT_ACCOUNT>", True, r"(?:支付宝|支付账号|收款账号|payment\s+account)[:：\s]{0,3}([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|1[3-9]\d{9}|[A-Za-z][A-Za-z0-9_-]{5,30})"),
    "address": ("address", "high", "<ADDRESS>", True, r"(?:家庭住址|住址|地址|Address)(?:登记为|为|是|[:：\s]){0,4}([^，。；;\n]{4,80}?)(?=，?(?:监护人|家长|联系电话|家校|邮箱)|[。；;\n]|$)"),
    "score_record": ("education_record", "medium", "<EDU_RECORD>", True, rf"((?:{_SUBJECTS})\s*\d{{1,3}}\s*分(?:[、，,\s]*(?:{_SUBJECTS})\s*\d{{1,3}}\s*分)+|(?:成绩单|成绩记录|report\s+card|exam\s+score))"),
    "disciplinary_record": ("education_record", "medium", "<EDU_RECORD>", False, r"((?:多次迟到|旷课|处分|违纪|漏交作业)[^。；;\n]{0,30}|(?:写入成长档案|德育处)[^。；;\n]{0,30})"),
    "medical_psychological_record": ("medical_record", "high", "<MEDICAL_RECORD>", False, r"((?:焦虑|抑郁|睡眠差|睡眠不好|胃痛|心理咨询|心理测评|压力评估|校医室|病历|健康随访)[^。；;\n]{0,40})"),
    "secret_api_key": ("secret", "critical", "<SECRET>", True, r"((?:sk|pk|ak|api[_-]?key|token|secret)[-_A-Za-z0-9]{8,}|(?:EduPass|Pass|Password|Pwd)[@:_-]?[A-Za-z0-9@#$%^&*._-]{4,})"),
    "minor_age": ("minor_info", "high", "<MINOR_INFO>", False, r"((?:\d{1,2}\s*岁|[一二三四五六七八九]年级(?:[一二三四五六七八九十]+班)?|初[一二三四五六七八九][^，。；;\n]{0,8}))"),
}
# What a text must hold for a rule to match it, in small letters; rules without an entry are always run.
HINTS = {
    "person_name_cn": ("姓名",), "person_name_en": ("name", "student", "parent", "guardian"), "student_name_context_cn": ("学生", "同学"), "teacher_name_context_cn": ("班主任",),
    "guardian_name_context_cn": ("监护人", "开户名", "妈妈叫", "父亲叫", "母亲叫"), "email": ("@",), "phone_cn": (kernels.DIGITS,), "phone_spoken_cn": ("手机号", "电话", "联系方式"),
    "phone_generic": (kernels.DIGITS,), "phone_context_generic": ("phone", "tel", "mobile", "联系方式", "电话"), "id_card_cn": (kernels.DIGITS,), "id_card_spoken_cn": ("身份证",),
    "passport": ("护照", "passport"), "bank_card": (kernels.DIGITS,), "student_id": ("学号", "学生编号", "student"), "student_id_spoken_cn": ("学号", "学生编号", "准考证号"),
    "parent_contact": ("家长", "parent"), "social_account": ("微信", "qq", "钉钉", "社交账号", "social"), "payment_account": ("支付宝", "支付账号", "收款账号", "payment"),
    "address": ("住址", "地址", "address"), "score_record": ("分", "成绩单", "成绩记录", "report", "exam"), "disciplinary_record": ("多次迟到", "旷课", "处分", "违纪", "漏交作业", "写入成长档案", "德育处"),
    "medical_psychological_record": ("焦虑", "抑郁", "睡眠差", "睡眠不好", "胃痛", "心理咨询", "心理测评", "压力评估", "校医室", "病历", "健康随访"),
    "secret_api_key": ("sk", "pk", "ak", "api", "token", "secret", "pass", "pwd"), "minor_age": ("岁", "年级", "初"),
}
AROUND = 12
# Risk types that need adjudication, that make an identity, and that are strong spans.
ADJUDICATED = ("person_name", "education_record", "bank_card")
IDENTITY = ("person_name", "phone_number", "id_card", "address", "student_id", "parent_contact", "bank_card")
IDENTITY_ALIAS = {"phone": "phone_number", "bank_account": "bank_card", "payment_account": "bank_card", "social_account": "parent_contact"}
STRONG = ("id_card", "bank_card", "email", "student_id", "secret")
# Shapes of valid values, and marks of a phone's context.
ID_CARD = r"^[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]$"
MOBILE = r"^(?:\+?86[-\s]?)?1[3-9]\d{9}$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE_MARKS = "电话|手机号|联系方式|联系电话|tel|phone"
BAD_NAMES = ("本人手机号", "联系电话", "联系方式", "家庭住址", "家长联系", "常用邮箱")
BAD_NAME = "手机号|联系电话|联系方式|住址|邮箱"


def spoken_digits(value: Column) -> Column:
    """Digits of a spoken number; X stays."""
    return F.regexp_replace(F.translate(value, "零〇○洞Oo幺一二两三四五六七八九x", "00000011223456789X"), "[^0-9X]", "")


def confidence_of(severity: Column, adjudicated: Column) -> Column:
    base = F.least(F.lit(0.99), lookup(severity, SEVERITY_WEIGHT, 0.3) + 0.08)
    return F.round(F.when(adjudicated, F.greatest(F.lit(0.4), base - 0.22)).otherwise(base), 4)


def recall(docs: DataFrame, text: str = "text", rules: dict | None = None) -> DataFrame:
    """Findings before post-processing: doc_id, ord, rule, risk_type, policy_tag, severity, confidence, needs_adjudication, replacement, start, end, match."""
    rules = rules or RULES
    found = kernels.rule_spans(docs, {n: (r[4], re.IGNORECASE if r[3] else 0, 1) for n, r in rules.items()}, text, HINTS if rules is RULES else None, AROUND)
    rule = F.col("rule")
    out = found.withColumn("risk_type", lookup(rule, {n: r[0] for n, r in rules.items()})).withColumn("severity", lookup(rule, {n: r[1] for n, r in rules.items()}))
    out = out.withColumn("replacement", lookup(rule, {n: r[2] for n, r in rules.items()})).withColumn("policy_tag", F.concat(F.lit("pii."), F.col("risk_type")))
    out = out.withColumn("needs_adjudication", F.col("risk_type").isin(*ADJUDICATED))
    return out.withColumn("confidence", confidence_of(F.col("severity"), F.col("needs_adjudication")))


def post_processed(findings: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Findings whose value holds up; each later step sees what the earlier ones kept.

    All that a step looks at came with the finding (near: its match with ``AROUND`` characters on either side), so texts are not read again.
    """
    value, around = F.trim("match"), F.lower("near")
    digits, spoken = F.regexp_replace(value, r"\D", ""), spoken_digits(value)
    rule, risk = F.col("rule"), F.col("risk_type")
    named = (rule == "person_name_cn") & (value.isin(*BAD_NAMES) | value.rlike(BAD_NAME) | ((F.col("confidence") <= 0.45) & ((F.length(value) > 4) | ~value.rlike("^[一-鿿·]*$"))))
    generic = (rule == "phone_generic") & (digits.rlike(ID_CARD) | (~value.rlike(MOBILE) & ~value.rlike(r"[-\s()]") & ~around.rlike(PHONE_MARKS)))
    bad = named | generic | ((rule == "phone_spoken_cn") & ((F.length(spoken) != 11) | ~spoken.rlike(MOBILE))) | ((rule == "id_card_spoken_cn") & ~spoken.rlike(ID_CARD))
    bad = bad | ((rule == "student_id_spoken_cn") & (F.length(spoken) < 5)) | ((risk == "bank_card") & digits.rlike(ID_CARD))
    bad = bad | ((risk == "address") & (value.contains("共同出现") | value.rlike("^[、，,]")))
    f = findings.filter(~bad)
    # addresses: without blanks around and without a leading copula, up to the next field; too short ones go
    cut = F.regexp_replace(F.regexp_replace(value, "^(登记为|为|是)", ""), r"(?s)(?:，监护人|，家长|，联系电话|，家校|，邮箱|。|；|;|\n).*$", "")
    lead = F.length("match") - F.length(F.ltrim("match")) + F.length(F.regexp_extract(value, "^(登记为|为|是)", 1))
    f = f.withColumn("_cut", F.when(risk == "address", cut)).withColumn("start", F.when(risk == "address", F.col("start") + lead).otherwise(F.col("start")))
    f = f.withColumn("end", F.when(risk == "address", F.col("start") + F.length("_cut")).otherwise(F.col("end"))).withColumn("match", F.coalesce("_cut", "match"))
    f = f.filter((risk != "address") | (F.length("match") >= 4)).drop("_cut", "near")
    return deduplicated(outside_stronger(f).filter((risk != "email") | F.col("match").rlike(EMAIL)))


def outside_stronger(f: DataFrame) -> DataFrame:
    """Anti-joins on intervals within a document: phones strictly inside a strong span, parent contacts inside an email or phone."""
    keep = ["doc_id", "start", "end"]
    strong = f.filter(F.col("risk_type").isin(*STRONG)).select(*[F.col(c).alias(f"s_{c}") for c in keep])
    inside = (F.col("doc_id") == F.col("s_doc_id")) & (F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end"))
    other = (F.col("s_start") != F.col("start")) | (F.col("s_end") != F.col("end"))
    out = merged(f, strong, inside & other & (F.col("risk_type") == "phone_number"), "left_anti")
    holder = f.filter(F.col("risk_type").isin("email", "phone", "phone_number")).select(*[F.col(c).alias(f"s_{c}") for c in keep])
    return merged(out, holder, inside & (F.col("risk_type") == "parent_contact"), "left_anti")


def deduplicated(f: DataFrame) -> DataFrame:
    """Best confidence for each span and tag; the first of equals."""
    w = Window.partitionBy("doc_id", "start", "end", "policy_tag").orderBy(F.col("confidence").desc(), "ord")
    return f.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def combined_identity(f: DataFrame, least: int = 2) -> DataFrame:
    """A row for each document with at least ``least`` kinds of identity data."""
    kind = F.coalesce(lookup(F.col("risk_type"), IDENTITY_ALIAS), F.col("risk_type"))
    kinds = f.withColumn("kind", kind).filter(F.col("kind").isin(*IDENTITY)).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return kinds.filter(F.size("kinds") >= least).select("doc_id", "kinds", F.lit("combined_identity").alias("risk_type"), F.lit("critical").alias("severity"), F.lit(0.92).alias("confidence"))


def document_results(docs: DataFrame, findings: DataFrame, low: float = 0.35, high: float = 0.85) -> DataFrame:
    """doc_id, n_findings, risk_score, needs_adjudication, status (clear, flagged or hard_case) of every document."""
    combined = combined_identity(findings)
    columns = ["doc_id", "severity", "confidence", "needs_adjudication"]
    every = findings.select(*columns).unionByName(combined.withColumn("needs_adjudication", F.lit(True)).select(*columns))
    agg = every.groupBy("doc_id").agg(F.count("*").alias("n_findings"), F.max(lookup(F.col("severity"), SEVERITY_WEIGHT, 0.3) * F.col("confidence")).alias("s"), F.bool_or("needs_adjudication").alias("needs_adjudication"))
    out = merged(docs.select("doc_id"), agg, "doc_id", "left")
    score = F.round(F.coalesce("s", F.lit(0.0)), 4)
    need = F.coalesce("needs_adjudication", F.lit(False))
    status = F.when(F.coalesce("n_findings", F.lit(0)) == 0, "clear").when(need | score.between(low, high), "hard_case").otherwise("flagged")
    return out.select("doc_id", F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"), score.alias("risk_score"), need.alias("needs_adjudication"), status.alias("status"))


# Other names of risk types, for selections.
ALIASES = {
    "phone": "phone_number", "id_number": "id_card", "bank_account": "bank_card", "payment_account": "bank_card", "guardian_contact": "parent_contact", "score_record": "education_record", "disciplinary_record": "education_record",
    "psychological_record": "medical_record", "health_record": "medical_record", "api_key": "secret", "token": "secret", "password": "secret", "credential": "secret",
}


def selected_entities(findings: DataFrame, selected: list[str]) -> DataFrame:
    """Findings whose risk type is selected, by any of its names; all where nothing is selected."""
    if not selected:
        return findings
    wanted = [*{*selected, *(ALIASES.get(s, s) for s in selected)}]
    return findings.filter(F.col("risk_type").isin(*wanted) | F.coalesce(lookup(F.col("risk_type"), ALIASES), F.col("risk_type")).isin(*wanted))
