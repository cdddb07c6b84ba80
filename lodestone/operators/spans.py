"""Overlapping findings: which are redacted, which are suppressed by which, and the redacted view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.ranks import SEVERITY, lookup

# Priority of risk types, and replacements where a finding brings none.
PRIORITY = {
    "id_card": 100, "email": 98, "bank_card": 92, "bank_account": 92, "payment_account": 90, "secret": 96, "api_key": 96, "token": 96, "password": 96,
    "phone": 85, "phone_number": 85, "student_id": 80, "medical_record": 82, "psychological_record": 82, "education_record": 79, "minor_info": 77,
    "parent_contact": 78, "social_account": 76, "vehicle_identifier": 75, "address": 74, "person_name": 60, "organization": 55, "url": 30, "pii_entity": 20,
}
LABELS = ("姓名", "名字", "学生", "家长", "联系人", "本人手机号", "联系电话", "联系方式", "家庭住址", "家庭住址登记", "家庭住址登记为", "name", "student", "parent", "guardian")
ITEM = "struct<p:int,s:int,c:double,n:int,o:int,start:int,end:int,risk:string,replacement:string>"


def priority(risk: Column, source: Column) -> Column:
    tool = F.lower(source)
    adjust = F.when(tool.contains("phone_generic"), -25).when(tool.contains("bank_card"), -5).when(tool.contains("id_card"), 10).when(tool.contains("presidio") | tool.contains("gliner"), 3).otherwise(0)
    return lookup(risk, PRIORITY, 10) + adjust


def unfit(source: str = "rule") -> Column:
    """Why a finding is no personal data, or null: label_only_span or invalid_privacy_span."""
    risk, value, tool = F.col("risk_type"), F.trim("match"), F.lower(source)
    label = (risk == "person_name") & F.lower(value).isin(*LABELS)
    name = (risk == "person_name") & (value.rlike("手机号|联系电话|联系方式|住址|邮箱") | (tool.contains("person_name_cn") & (F.col("confidence") <= 0.45) & (F.length(value) > 4)))
    address = (risk == "address") & (value.rlike("^[、，,]") | value.rlike("共同出现|唯一定位"))
    return F.when(label, "label_only_span").when(name | address, "invalid_privacy_span")


def resolved(findings: DataFrame, source: str = "rule") -> DataFrame:
    """A document a row: selected spans, and suppressed ones (by: the finding that won, or null with the reason in why).

    Field labels and invalid values are suppressed first (see :func:`unfit`). Findings come best first (priority, severity, confidence, length, then order of
    finding); one that overlaps none selected so far is selected, another is suppressed
    by the selected one it overlaps most. A document's findings are folded in one expression.
    """
    f = findings.filter(F.col("end") > F.col("start"))
    rank = lookup(F.col("severity"), {s: i + 1 for i, s in enumerate(SEVERITY)}, 0)
    size = F.col("end") - F.col("start")
    # negated keys, so that ascending order is best first and ties keep their order
    item = F.struct((-priority(F.col("risk_type"), F.col(source))).cast("int").alias("p"), (-rank).alias("s"), (-F.col("confidence")).alias("c"), (-size).alias("n"), F.col("ord").alias("o"), "start", "end", F.col("risk_type").alias("risk"), "replacement")
    why = unfit(source)
    fit = F.filter(F.collect_list(F.struct(why.alias("why"), item.alias("x"))), lambda v: v["why"].isNull())
    out = F.filter(F.collect_list(F.struct(F.col("ord").alias("o"), F.lit(None).cast("int").alias("by"), why.alias("why"))), lambda v: v["why"].isNotNull())
    per = f.groupBy("doc_id").agg(F.array_sort(F.transform(fit, lambda v: v["x"])).alias("items"), F.array_sort(out).alias("out"))
    init = F.struct(F.array().cast(f"array<{ITEM}>").alias("kept"), F.col("out").alias("lost"))

    def step(acc: Column, x: Column) -> Column:
        hits = F.filter(acc["kept"], lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        best = F.array_max(F.transform(hits, lambda k: F.struct((F.least(k["end"], x["end"]) - F.greatest(k["start"], x["start"])).alias("v"), (-k["p"]).alias("p"), (-k["s"]).alias("s"), (-k["c"]).alias("c"), (-k["n"]).alias("n"), (-k["o"]).alias("o"))))
        free = F.size(hits) == 0
        return F.struct(
            F.when(free, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
            F.when(free, acc["lost"]).otherwise(F.concat(acc["lost"], F.array(F.struct(x["o"].alias("o"), (-best["o"]).alias("by"), F.lit("overlap").alias("why"))))).alias("lost"),
        )

    return per.select("doc_id", F.aggregate("items", init, step).alias("r")).select("doc_id", F.col("r.kept").alias("kept"), F.col("r.lost").alias("lost"))


def targets(resolution: DataFrame) -> DataFrame:
    """doc_id, start, end, risk_type, replacement of selected spans."""
    return resolution.select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.start", "k.end", F.col("k.risk").alias("risk_type"), "k.replacement")


def redacted(docs: DataFrame, chosen: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, redacted: targets spliced in; selected spans never overlap, so one walk from left to right will do.

    Texts meet the hashed spans of their share of documents: neither are texts sorted nor spans sent through the driver.
    """
    per = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("x"))
    t = F.col(text)
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(t, acc["at"] + 1, x["start"] - acc["at"]), x["replacement"]).alias("out"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    joined = docs.select("doc_id", text).join(per.hint("shuffle_hash"), "doc_id", "left").withColumn("r", F.aggregate(F.coalesce("x", none), init, step))
    return joined.select("doc_id", F.concat(F.col("r.out"), F.substr(t, F.col("r.at") + 1, F.length(t))).alias("redacted"))
