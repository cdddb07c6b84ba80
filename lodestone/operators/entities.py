"""Entities of transcripts and of external recognisers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import kernels
from lodestone.operators.evidence import valid_id_card
from lodestone.ranks import lookup

# Entity -> (pattern, ignores case, group, score, score near a context word), in the order in which they are asked.
PATTERNS = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False, 0, 0.95, 0.95),
    ("CN_PHONE_NUMBER", r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)", False, 0, 0.82, 0.93),
    ("PHONE_NUMBER", r"(?:\+?1[\s-]?)?(?:\(?\d{3}\)?[\s-]?)\d{3}[\s-]?\d{4}", False, 0, 0.82, 0.82),
    ("PHONE_NUMBER", r"(?<!\d)0\d{2,3}[-\s]?\d{7,8}(?!\d)", False, 0, 0.0, 0.78),
    ("CN_ID_CARD", r"(?<!\d)[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", False, 0, 0.94, 0.98),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", False, 0, 0.9, 0.9),
    ("CREDIT_CARD", r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)", False, 0, 0.86, 0.95),
    ("STUDENT_ID", r"(?:学号|学生编号|准考证号|考号|student\s*id)[:：\s-]*([A-Za-z0-9_-]{4,32})", True, 1, 0.86, 0.86),
    ("WECHAT_ID", r"(?:微信号?|\bwechat\b)[:：\s-]*([A-Za-z][A-Za-z0-9_-]{5,19})", True, 1, 0.82, 0.82),
    ("QQ_NUMBER", r"(?:\bQQ\b|腾讯QQ)[:：\s-]*([1-9]\d{4,11})", True, 1, 0.82, 0.82),
    ("PARENT_CONTACT", r"(?:家长(?:电话|手机|联系方式)|parent(?:\s+contact|\s+phone)?)[:：\s-]*([+0-9A-Za-z@._ -]{5,40})", True, 1, 0.84, 0.84),
    ("LICENSE_PLATE", r"[一-龥][A-Z][A-Z0-9]{5,6}", False, 0, 0.82, 0.82),
    ("LOCATION", r"[一-龥]{2,}(?:省|市|自治区)[一-龥]{0,20}(?:区|县|镇|乡|街道)[一-龥A-Za-z0-9\-]{0,40}(?:路|街|巷|弄|号|小区|宿舍|楼|室)", False, 0, 0.8, 0.8),
]
CONTEXT = {
    "CN_PHONE_NUMBER": ("手机", "电话", "联系方式", "联系电话", "家长电话"), "PHONE_NUMBER": ("手机", "电话", "联系方式", "联系电话", "家长电话"),
    "CN_ID_CARD": ("身份证", "身份证号", "公民身份号码", "证件号"), "CREDIT_CARD": ("银行卡", "卡号", "账号", "收款账户"),
}
AROUND = 24


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits, whatever stands between them, have a valid check digit."""
    d = F.regexp_replace(value, "\\D", "")
    return F.length(d).between(12, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def recalled(units: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ord, entity, start, end, match, score of everything the patterns find and the check digits allow."""
    rules = {f"{k:02d}": (rx, re.IGNORECASE if i else 0, g) for k, (_, rx, i, g, _, _) in enumerate(PATTERNS)}
    found = kernels.rule_spans(units, rules, text, None, AROUND)
    nth, near = F.col("rule").cast("int"), F.lower("near")
    of = lambda k: lookup(nth, {n: p[k] for n, p in enumerate(PATTERNS)})
    out = found.withColumn("entity", of(0))
    said = F.lit(False)
    for entity, words in CONTEXT.items():
        met = F.lit(False)
        for w in words:
            met = met | near.contains(w)
        said = said | ((F.col("entity") == entity) & met)
    out = out.withColumn("score", F.when(said, of(5)).otherwise(of(4)))
    ok = F.when(F.col("entity") == "CN_ID_CARD", valid_id_card(F.col("match"))).when(F.col("entity") == "CREDIT_CARD", luhn(F.col("match"))).otherwise(True)
    return out.filter(ok & (F.col("score") > 0)).select("doc_id", "ord", "entity", "start", "end", "match", "score")


def without_overlaps(entities: DataFrame) -> DataFrame:
    """Entities that stay, by score, start and length: one goes if it overlaps a kept one. A document's entities are folded in one expression."""
    item = F.struct((-F.col("score")).alias("s"), F.col("start").alias("a"), (F.col("start") - F.col("end")).alias("n"), "ord", F.col("end").alias("z"), "entity", "match")
    per = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    kind = "array<struct<s:double,a:int,n:int,ord:int,z:int,entity:string,match:string>>"
    step = lambda kept, e: F.when(F.exists(kept, lambda k: (e["a"] < k["z"]) & (e["z"] > k["a"])), kept).otherwise(F.concat(kept, F.array(e)))
    k = per.select("doc_id", F.explode(F.aggregate("x", F.array().cast(kind), step)).alias("k"))
    return k.select("doc_id", F.col("k.entity").alias("entity"), F.col("k.a").alias("start"), F.col("k.z").alias("end"), F.col("k.match").alias("match"), (-F.col("k.s")).alias("score"))


# Endings and names of public organisations.
ENDINGS = ("大学", "学院", "学校", "中学", "小学", "幼儿园", "教育局", "研究中心", "研究院", "出版社", "平台", "联盟", "基地", "公司", "集团", "医院")
PUBLIC = ("清华大学", "北京大学", "北大", "复旦大学", "中国科技大学", "麻省理工", "海南医科大学", "学堂在线", "教育部在线教育研究中心", "世界慕课联盟")


def public_organisation(value: Column) -> Column:
    """Whether a name is that of a public organisation, holds one, or ends like one."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), "(?U)\\s+", "")
    return v.rlike("|".join(PUBLIC)) | v.rlike(f"(?:{'|'.join(ENDINGS)})$")


# Entity of an external recogniser -> (risk type, policy tag, severity, replacement), and the least score.
RECOGNISED = {
    "EMAIL_ADDRESS": ("email", "pii.email", "low", "<EMAIL>"), "PHONE_NUMBER": ("phone", "pii.phone", "medium", "<PHONE>"), "PERSON": ("person_name", "pii.person_name", "low", "<PERSON>"),
    "ORGANIZATION": ("organization", "pii.organization", "low", "<ORGANIZATION>"), "LOCATION": ("address", "pii.address", "medium", "<ADDRESS>"), "CREDIT_CARD": ("bank_card", "pii.bank_card", "high", "<BANK_CARD>"),
    "CRYPTO": ("crypto_wallet", "pii.crypto_wallet", "high", "<CRYPTO_WALLET>"), "IBAN_CODE": ("bank_account", "pii.bank_account", "high", "<BANK_ACCOUNT>"), "BANK_ACCOUNT": ("bank_account", "pii.bank_account", "high", "<BANK_ACCOUNT>"),
    "IP_ADDRESS": ("ip_address", "pii.ip_address", "low", "<IP_ADDRESS>"), "URL": ("url", "pii.url", "low", "<URL>"), "ID_CARD": ("id_card", "pii.id_card", "high", "<ID_CARD>"), "PASSPORT": ("id_card", "pii.id_card", "high", "<ID_CARD>"),
    "DRIVER_LICENSE": ("id_card", "pii.id_card", "high", "<ID_CARD>"), "US_SSN": ("id_card", "pii.id_card", "high", "<ID_CARD>"), "US_DRIVER_LICENSE": ("id_card", "pii.id_card", "high", "<ID_CARD>"), "US_PASSPORT": ("id_card", "pii.id_card", "high", "<ID_CARD>"),
    "CN_ID_CARD": ("id_card", "pii.id_card", "high", "<ID_CARD>"), "CN_PHONE_NUMBER": ("phone", "pii.phone", "medium", "<PHONE>"), "STUDENT_ID": ("student_id", "pii.student_id", "medium", "<STUDENT_ID>"),
    "PARENT_CONTACT": ("parent_contact", "pii.parent_contact", "high", "<PARENT_CONTACT>"), "EDUCATION_RECORD": ("education_record", "pii.education_record", "medium", "<EDU_RECORD>"), "WECHAT_ID": ("social_account", "pii.social_account.wechat", "medium", "<WECHAT_ID>"),
    "QQ_NUMBER": ("social_account", "pii.social_account.qq", "medium", "<QQ_NUMBER>"), "ALIPAY_ID": ("payment_account", "pii.payment_account.alipay", "high", "<ALIPAY_ID>"), "LICENSE_PLATE": ("vehicle_identifier", "pii.vehicle.license_plate", "medium", "<LICENSE_PLATE>"),
}
LEAST_SCORE = 0.45


def as_findings(entities: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Entities (entity, score) as findings: risk_type, policy_tag, severity, replacement; unknown entities and low scores go."""
    named = {n: lookup(F.col("entity"), {e: v[k] for e, v in RECOGNISED.items()}) for k, n in enumerate(("risk_type", "policy_tag", "severity", "replacement"))}
    return entities.filter(F.col("score") >= least).withColumns(named).filter("risk_type is not null")
