"""Content recall by keywords, candidate windows and their joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import kernels
from lodestone.ranks import SEVERITY_WEIGHT, lookup
from lodestone.tables import merged

# Category -> (policy tag, risk type, severity, keywords).
PACK = {
    "violence": ("content.violent", "violence", "critical", ["bomb", "terrorism", "weapon", "shooting", "炸弹", "爆炸物", "恐怖袭击", "凶器", "管制刀具", "带刀", "拿刀", "堵人", "打死", "杀了"]),
    "violent_encouragement": ("content.violent.encouragement", "violence", "high", ["teach me how to make a bomb", "how to make a bomb", "commit terrorism", "kill them all", "怎么做炸弹", "制作炸弹", "教我做炸弹", "带把刀吓", "放学堵", "约架", "打群架", "把他打一顿"]),
    "violent_graphic_description": ("content.violent.graphic_description", "violence", "medium", ["graphic gore", "bloody corpse", "dismembered body", "血肉模糊", "尸体", "肢解", "砍伤", "血腥"]),
    "illegal_instruction_step_by_step": ("content.illegal_instruction.step_by_step", "illegal_instruction", "high", ["step by step exploit", "bypass alarm system", "make illegal drugs", "改成绩", "进教务系统", "弄到别人的校园账号", "考试答案", "泄题", "作弊教程", "绕过审核", "盗号"]),
    "hate_group_attack": ("content.hate.group_attack", "hate_speech", "high", ["racial hatred", "genocide", "exterminate", "外地学生", "不该和本地学生", "都是来抢名额的", "滚出学校", "歧视"]),
    "harassment_shaming": ("content.harassment.shaming", "harassment", "medium", ["publicly shame", "humiliate this student", "bullying", "霸凌", "欺负", "点名骂", "废物", "拖后腿", "一起笑他", "羞辱", "人身攻击"]),
    "self_harm_encouragement": ("content.self_harm.encouragement", "self_harm", "critical", ["suicide", "end my life", "self harm", "不想活了", "自杀", "自残", "轻生", "伤害自己", "结束生命", "活不下去"]),
    "pornographic_explicit": ("content.pornographic.explicit", "pornographic_content", "high", ["porn", "explicit sex", "sexual service", "成人聊天群", "露骨", "色情", "裸聊", "性服务", "低俗"]),
    "minor_harmful_imitation": ("content.minor_harmful.imitation", "minor_harmful", "high", ["students should try this dangerous stunt", "children should copy this", "minors should imitate", "学生模仿", "未成年人模仿", "危险挑战", "带学生去做"]),
    "minor_harmful_sexualization": ("content.minor_harmful.sexualization", "minor_harmful", "critical", ["minor sexual", "underage explicit", "未成年色情", "未成年人裸聊", "拉同学进成人聊天群"]),
    "misleading_pseudo_authority": ("content.misleading.pseudo_authority", "misleading", "medium", ["fake school certificate", "guaranteed exam leak", "official secret answer", "保证进重点班", "升学渠道", "交四千", "包过", "内部名额", "保录取", "伪造证书"]),
    "values_violation_manipulation": ("content.values_violation.manipulation", "values_violation", "medium", ["manipulate students", "pressure learners", "coercive persuasion", "威胁学生", "诱导学生", "操纵学生", "逼迫学生", "鼓动学生"]),
    "jailbreak_prompt_injection": ("content.jailbreak.prompt_injection", "jailbreak_attempt", "high", ["ignore previous instructions", "bypass safety", "reveal the hidden system prompt", "jailbreak", "不要管这些内容", "直接当普通聊天通过", "忽略前面的规则", "绕过安全检测", "越狱", "透露系统提示词"]),
}
# Words that make a hit nearby ambiguous.
MARKERS = ["news", "article", "report", "textbook", "class", "education", "research", "discussion", "quote", "fictional"]
AROUND = 50


def keyword_findings(docs: DataFrame, pack: dict = PACK, markers: list[str] = MARKERS, text: str = "text") -> DataFrame:
    """doc_id, ord, keyword, category, policy_tag, risk_type, severity, confidence, needs_adjudication, start, end, match.

    Every keyword is looked for in the lower-cased text; a marker within 50 characters lowers the confidence and asks for adjudication.
    """
    of = {k.lower(): c for c, (_, _, _, ks) in pack.items() for k in ks}
    low = docs.select("doc_id", F.lower(text).alias("low"))
    hits = kernels.rule_spans(low, {k: (re.escape(k), 0, 0) for k in of}, "low", {k: (kernels.folded(k),) for k in of}, AROUND)
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.col("near").contains(m)
    out = hits.withColumnRenamed("rule", "keyword").withColumn("category", lookup(F.col("keyword"), of)).withColumn("needs_adjudication", marked).drop("near")
    for k, name in enumerate(("policy_tag", "risk_type", "severity")):
        out = out.withColumn(name, lookup(F.col("category"), {c: v[k] for c, v in pack.items()}))
    base = F.least(F.lit(0.98), lookup(F.col("severity"), SEVERITY_WEIGHT, 0.3) + 0.1)
    return out.withColumn("confidence", F.round(F.when(F.col("needs_adjudication"), F.greatest(F.lit(0.35), base - 0.28)).otherwise(base), 4))


def packed_windows(docs: DataFrame, most: int = 360, text: str = "text") -> DataFrame:
    """doc_id, window, start, end: sentences packed in order into windows of at most ``most`` characters; a longer sentence is a window of its own.

    Sentences end after ! ? or the wide forms of . ! ?; blank ones are left out, but a window reaches over those inside it.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"(?sd).+?(?:[。！？!?]|$)"), F.lit(0))
    sizes = docs.select("doc_id", F.transform(pieces, lambda s: F.struct(F.length(s).alias("n"), s.rlike(r"(?U)\S").alias("real"))).alias("sizes"))
    init = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.lit(-1).alias("to"), F.lit(0).alias("held"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["to"] >= 0) & (acc["held"] + x["n"] > most)
        first = (acc["to"] < 0) | new
        done = F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))
        at = acc["at"] + x["n"]
        return F.when(x["real"], F.struct(at.alias("at"), F.when(first, acc["at"]).otherwise(acc["from"]).alias("from"), at.alias("to"), F.when(first, x["n"]).otherwise(acc["held"] + x["n"]).alias("held"), F.when(new, done).otherwise(acc["out"]).alias("out"))).otherwise(
            F.struct(at.alias("at"), acc["from"].alias("from"), acc["to"].alias("to"), acc["held"].alias("held"), acc["out"].alias("out"))
        )

    last = lambda acc: F.when(acc["to"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["out"])
    win = sizes.select("doc_id", F.posexplode(F.aggregate("sizes", init, step, last)).alias("window", "w"))
    return win.select("doc_id", "window", "w.start", "w.end")


def candidate_windows(docs: DataFrame, hits: DataFrame, most: int = 360) -> DataFrame:
    """doc_id, window, start, end, labels of the windows that a hit begins or ends in, or covers; others are no candidates."""
    met = docs.join(hits.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")  # texts are not sorted for it
    near = windows_with_hits(packed_windows(met, most), hits, "policy_tag")
    return near.groupBy("doc_id", "window", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("policy_tag")), ",").alias("labels"))


def windows_with_hits(windows: DataFrame, hits: DataFrame, what: str = "keyword") -> DataFrame:
    """Interval join within a document: a window for each hit that begins or ends in it, or covers it."""
    h = hits.select(F.col("doc_id").alias("_d"), F.col("start").alias("hit_start"), F.col("end").alias("hit_end"), what)
    meets = (F.col("doc_id") == F.col("_d")) & (F.col("hit_start") < F.col("end")) & (F.col("hit_end") > F.col("start"))
    return merged(windows, h, meets).drop("_d")


def document_results(docs: DataFrame, findings: DataFrame, low: float = 0.35, high: float = 0.85) -> DataFrame:
    """doc_id, n_findings, risk_score, needs_adjudication, status of every document."""
    from lodestone.operators.privacy import document_results as results

    none = findings.withColumn("risk_type", F.lit("content"))
    return results(docs, none, low, high)
