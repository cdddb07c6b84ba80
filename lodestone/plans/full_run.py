"""One text run from recall to packages: context, localisation, adjudication, assessments, evidence, decision.

Every table is keyed by doc_id; what several steps read is written once, above all the two recalls;
:meth:`FullRun.done` deletes what was written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import adjudication, content, decisions, evidence, privacy, spans
from lodestone.ranks import DISPOSITION, DISPOSITION_DECISION, DISPOSITION_RISK, code, lookup, rank
from lodestone.tables import Steps, merged

# Priority and delivery by disposition; who says what in a run without models; terms that tell self-harm, public events and illegal advice.
PRIORITY = {"P2": "normal", "P3": "high", "P4": "critical", "P5": "critical"}
DELIVERY = {"P0": "deliver", "P1": "deliver", "P2": "hold", "P3": "hold", "P4": "block", "P5": "block"}
SELF_HARM = ("自杀", "自残", "伤害自己", "不想活", "轻生", "suicide", "self-harm", "kill myself")
PUBLIC = ("公共事件", "隐瞒真相", "市中心集合", "别报备", "集合", "通知", "游行", "protest", "assembly")
ILLEGAL = ("改成绩", "考试答案", "校园账号", "私聊", "保证录取", "3999", "黑客", "作弊", "诈骗")


def relabelled(text: Column, explanation: Column, risk: Column, tag: Column) -> tuple[Column, Column]:
    """Risk type and policy tag of a model's fragment: self-harm without any of its terms is a public event, illegal advice, or only general."""
    any_of = lambda t, words: F.lit(False) if not words else _any([t.contains(w) for w in words])
    low = F.lower(F.concat_ws(" ", text, explanation))
    risk, tag = F.coalesce(F.when(F.trim(risk) != "", F.trim(risk)), F.lit("general_content_safety")), F.coalesce(F.when(F.trim(tag) != "", F.trim(tag)), F.lit("content.localized"))
    wrong = (risk == "self_harm") & ~any_of(low, SELF_HARM)
    public, illegal = wrong & any_of(text, PUBLIC), wrong & any_of(text, ILLEGAL)
    return (
        F.when(public, "political_sensitive").when(illegal, "illegal_instruction").when(wrong, "general_content_safety").otherwise(risk),
        F.when(public, "content.political").when(illegal, "content.illegal_instruction").when(wrong, "content.localized").otherwise(tag),
    )


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def localised(docs: DataFrame, windows: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """doc_id, window, risk_type, policy_tag, severity, confidence, start, end, degraded, source: what is risky in each candidate window.

    Every rule hit in a window is a fragment. A window without any takes a model's ``answers`` (doc_id, window, text, risk_type,
    policy_tag, severity, confidence, explanation) that stand in its text, at their first place; one that has none of either is
    a degraded fragment as a whole.
    """
    own = content.windows_with_hits(windows, hits.select("doc_id", "start", "end", F.struct("risk_type", "policy_tag", "severity", "confidence").alias("x")), "x")
    own = own.select("doc_id", "window", "x.risk_type", "x.policy_tag", "x.severity", "x.confidence", F.col("hit_start").alias("start"), F.col("hit_end").alias("end"), F.lit(False).alias("degraded"), F.lit("content_rule_localizer").alias("source"))
    rest = merged(windows.select("doc_id", "window", "start", "end"), own.select("doc_id", "window").distinct(), ["doc_id", "window"], "left_anti")
    if answers is not None:
        texts = rest.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").select("doc_id", "window", F.col("start").alias("_s"), F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start")).alias("_w"))
        said = answers.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text != ''").join(texts, ["doc_id", "window"]).filter(F.contains("_w", "text"))
        risk, tag = relabelled(F.col("text"), F.coalesce("explanation", F.lit("")), F.coalesce("risk_type", F.lit("")), F.coalesce("policy_tag", F.lit("")))
        start = F.col("_s") + F.instr("_w", F.col("text")) - 1
        severity = F.lower(F.coalesce("severity", F.lit("medium")))
        said = said.select("doc_id", "window", risk.alias("risk_type"), tag.alias("policy_tag"), F.when(severity.isin("critical", "high", "low"), severity).otherwise("medium").alias("severity"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"), start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("end"), F.lit(False).alias("degraded"), F.lit("model_content_localizer").alias("source"))
        rest = rest.join(said.select("doc_id", "window").distinct(), ["doc_id", "window"], "left_anti")
        own = own.unionByName(said)
    whole = rest.select("doc_id", "window", F.lit("general_content_safety").alias("risk_type"), F.lit("content.window_candidate").alias("policy_tag"), F.lit("medium").alias("severity"), F.lit(0.0).alias("confidence"), "start", "end", F.lit(True).alias("degraded"), F.lit("content_window_fallback").alias("source"))
    return own.unionByName(whole)


def assessments(content_said: DataFrame, privacy_said: DataFrame, content_found: DataFrame, privacy_found: DataFrame) -> DataFrame:
    """doc_id, chain, action, may_raise, confidence, review: both chains' assessments. One of a document without evidence in its chain may not raise anything."""

    def of(chain: str, said: DataFrame, found: DataFrame, sure: float, review: Column) -> DataFrame:
        seen = found.select("doc_id").distinct().withColumn("_seen", F.lit(True))
        j = merged(said, seen, "doc_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
        return j.select("doc_id", F.lit(chain).alias("chain"), F.col("recommended").alias("action"), F.col("_seen").alias("may_raise"), F.when(F.col("_seen"), sure).otherwise(0.92).alias("confidence"), review.alias("review"))

    r = F.col("recommended")
    return of("content", content_said, content_found, 0.74, ~r.isin("reject", "keep")).unionByName(of("privacy", privacy_said, privacy_found, 0.72, r == "manual_review"))


def evidence_events(content_found: DataFrame, privacy_found: DataFrame, judged: DataFrame, cases: DataFrame) -> DataFrame:
    """doc_id, category, risk_type, policy_tag, severity, confidence, disputed, suggestion: an event for each finding, for each assessment, and for a case of a document that has neither."""
    pick = ["doc_id", "risk_type", "policy_tag", "severity", "confidence"]
    found = content_found.select(*pick, F.lit("content_safety").alias("category"), F.lit("manual_review").alias("suggestion")).unionByName(privacy_found.select(*pick, F.lit("privacy").alias("category"), F.col("replacement").alias("suggestion")))
    case = cases.select("doc_id", "requires_manual_review", F.col("confidence").alias("_c"))
    found = merged(found, case, "doc_id", "left").withColumn("disputed", F.coalesce("requires_manual_review", F.lit(False))).drop("requires_manual_review", "_c")
    whole = judged.select(
        "doc_id", F.concat("chain", F.lit("_document_assessment")).alias("risk_type"), F.concat("chain", F.lit(".document_assessment")).alias("policy_tag"), F.when(F.col("review"), "medium").otherwise("low").alias("severity"),
        "confidence", F.concat("chain", F.lit("_document")).alias("category"), F.col("action").alias("suggestion"), F.col("review").alias("disputed"),
    )
    out = found.unionByName(whole)
    alone = merged(cases, out.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.unionByName(alone.select("doc_id", F.lit("adjudication_only").alias("risk_type"), F.lit("hard_case.final_judgement").alias("policy_tag"), F.lit("medium").alias("severity"), "confidence", F.lit("hard_case").alias("category"), F.lit("manual_review").alias("suggestion"), F.col("requires_manual_review").alias("disputed")))


def decided(docs: DataFrame, fragments: DataFrame, local: DataFrame, judged: DataFrame, events: DataFrame, cases: DataFrame, circulated: Column | None = None) -> DataFrame:
    """doc_id, disposition, decision, risk_score, actions, strategy, escalation, priority, reasons, n_events, summary, trust of every document.

    The disposition is the highest of the floors of fragments, localised fragments, assessments and events, and of the case's
    recommendation; what is already in circulation at P4 is P5. ``circulated`` is a column of ``docs``.
    """
    kind = F.when(F.col("category") == "content_safety", "content").when(F.col("category") == "privacy", "privacy").otherwise(F.col("category"))
    floors = events.filter(~F.col("category").isin("privacy_document", "content_document")).select("doc_id", kind.alias("chain"), decisions.event_floor(F.col("category"), F.col("risk_type"), F.col("severity"), F.col("disputed")).alias("floor"))
    floor = evidence.document_floor(docs, fragments, local, judged, floors)
    case = cases.select("doc_id", rank(F.col("recommended"), DISPOSITION).alias("_case"))
    seen = events.groupBy("doc_id").agg(F.count("*").alias("n_events"), F.collect_set("policy_tag").alias("_tags"))
    parts = local.groupBy("doc_id").agg(F.count("*").alias("_n"), F.bool_or("degraded").alias("_deg"))
    said = judged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat("chain", F.lit("_doc:"), "action"))).alias("_said"))
    out = docs.select("doc_id", (circulated if circulated is not None else F.lit(False)).alias("_circ"))
    for t in (floor.withColumnRenamed("disposition", "_floor"), case, seen, parts, said):
        out = merged(out, t, "doc_id", "left")
    top = F.greatest(rank(F.col("_floor"), DISPOSITION), F.coalesce("_case", F.lit(0)))
    top = F.when((top == 4) & F.coalesce("_circ", F.lit(False)), 5).otherwise(top)
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.coalesce("_tags", none), F.coalesce("_said", none), F.when(F.col("_n") > 0, F.array(F.concat(F.lit("content_localized_fragments:"), F.col("_n").cast("string")))).otherwise(none),
        F.when(F.col("_deg"), F.array(F.lit("content_localization:degraded"))).otherwise(none), F.when(F.col("_case").isNotNull(), F.array(F.lit("hard_case:heuristic"))).otherwise(none),
    )
    out = out.withColumn("disposition", code(top, DISPOSITION)).withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("bigint"))
    d = F.col("disposition")
    return out.select(
        "doc_id", "disposition", lookup(d, DISPOSITION_DECISION).alias("decision"), lookup(d, DISPOSITION_RISK).alias("risk_score"), *evidence.actions_of(d), lookup(d, PRIORITY, "low").alias("priority"), F.array_join(F.array_sort(F.array_distinct(reasons)), ",").alias("reasons"), "n_events",
        F.concat(d, F.lit(" decision derived from "), F.col("n_events").cast("string"), F.lit(" evidence events.")).alias("summary"), F.when(F.col("_case").isNotNull(), "degraded").otherwise("full").alias("trust"),
    )


@dataclass
class FullRun:
    """All tables of a run."""

    docs: DataFrame
    contexts: DataFrame
    windows: DataFrame
    localised: DataFrame
    content: DataFrame
    privacy: DataFrame
    content_results: DataFrame
    privacy_results: DataFrame
    content_fragments: DataFrame
    privacy_fragments: DataFrame
    assessments: DataFrame
    resolution: DataFrame
    targets: DataFrame
    cases: DataFrame
    events: DataFrame
    decisions: DataFrame
    steps: Steps

    def annotation(self) -> DataFrame:
        """What annotators get of each document: delivery, decision, priority, redacted text, its targets and conflicts, and up to five hints."""
        n = self.resolution.select("doc_id", F.size("kept").alias("n_targets"), F.size("lost").alias("n_conflicts"))
        hints = self.events.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("policy_tag")), 1, 5), ",").alias("hints"))
        told = merged(merged(self.decisions, n, "doc_id", "left"), hints, "doc_id", "left")
        out = spans.redacted(self.docs, self.targets).join(told.hint("shuffle_hash"), "doc_id")  # texts move once and are not sorted
        return out.select("doc_id", lookup(F.col("disposition"), DELIVERY).alias("delivery"), "disposition", "decision", "priority", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_targets", "n_conflicts")], F.coalesce("hints", F.lit("")).alias("hints"), "redacted")

    def audit(self) -> DataFrame:
        """A row a document of all that led to its decision: counts of each table, statuses, who answered, trust and a summary."""
        counts = {"n_windows": self.windows, "n_localised": self.localised, "n_content_fragments": self.content_fragments, "n_privacy_fragments": self.privacy_fragments, "n_targets": self.targets}
        out = self.decisions.select("doc_id", "disposition", "decision", "reasons", "n_events", "trust")
        for name, t in counts.items():
            out = merged(out, t.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
        out = merged(out, self.contexts.select("doc_id", "document_type", "minor"), "doc_id", "left")
        for name, t in (("content", self.content_results), ("privacy", self.privacy_results)):
            out = merged(out, t.select("doc_id", F.col("status").alias(f"{name}_status"), F.col("risk_score").alias(f"{name}_score")), "doc_id", "left")
        said = self.assessments.groupBy("doc_id").pivot("chain", ["content", "privacy"]).agg(F.first("action"))
        out = merged(out, said.withColumnsRenamed({"content": "content_action", "privacy": "privacy_action"}), "doc_id", "left")
        out = merged(out, self.cases.select("doc_id", F.lit("heuristic").alias("hard_case_provider")), "doc_id", "left")
        summary = F.concat("disposition", F.lit(" / "), "decision", F.lit(" with "), F.col("n_events").cast("string"), F.lit(" evidence events."))
        return out.fillna(0, [*counts]).fillna("", ["hard_case_provider"]).withColumn("audit_summary", summary)

    def summary(self) -> DataFrame:
        return decisions.run_summary(self.decisions)

    def done(self) -> None:
        self.steps.leave()


def run(docs: DataFrame, profile: str = "full", circulated: Column | None = None, answers: DataFrame | None = None) -> FullRun:
    """A whole run; privacy_only and safety_only leave the other chain without evidence. docs: doc_id, text."""
    if profile not in ("full", "privacy_only", "safety_only"):
        raise ValueError(profile)
    steps = Steps(docs.sparkSession)
    contexts = steps.keep(adjudication.document_context(docs))
    hits = steps.keep(content.keyword_findings(docs).filter(F.lit(profile != "privacy_only")))
    recalled = steps.keep(privacy.recall(docs).filter(F.lit(profile != "safety_only")))  # what follows reads it several times
    found_p = steps.keep(privacy.post_processed(recalled, docs))
    windows = content.candidate_windows(docs, hits)
    if answers is not None:  # a model also answers for windows without hits
        asked = content.packed_windows(docs).join(answers.select("doc_id", "window").distinct(), ["doc_id", "window"], "left_semi").withColumn("labels", F.lit("model"))
        windows = windows.unionByName(asked.join(windows.select("doc_id", "window"), ["doc_id", "window"], "left_anti"))
    windows = steps.keep(windows)
    local = steps.keep(localised(docs, windows, hits, answers))
    found_c = local.withColumn("needs_adjudication", F.lit(True))
    combined = privacy.combined_identity(found_p).select("doc_id", "risk_type", "severity", "confidence", F.lit("pii.combined_identity").alias("policy_tag"), F.lit("manual_review").alias("replacement"))
    every_p = found_p.select("doc_id", "risk_type", "severity", "confidence", "policy_tag", "replacement").unionByName(combined)
    results_c, results_p = content.document_results(docs, found_c), privacy.document_results(docs, found_p)
    # what a chain localises is a candidate until it is adjudicated
    results_c = results_c.withColumn("status", F.when(F.col("n_findings") > 0, "hard_case").otherwise(F.col("status")))
    frag_c, frag_p = adjudication.content_fragments(found_c, contexts), adjudication.privacy_fragments(every_p, contexts)
    judged = assessments(adjudication.content_assessment(docs, frag_c), adjudication.privacy_assessment(docs, frag_p, contexts), found_c, every_p)
    judged = steps.keep(judged)
    cases = steps.keep(decisions.hard_cases(docs, found_c, every_p, results_c, results_p))
    events = steps.keep(evidence_events(found_c, every_p, judged, cases))
    resolution = spans.resolved(found_p)
    pieces = frag_c.select("doc_id", F.lit("content").alias("chain"), "action").unionByName(frag_p.select("doc_id", F.lit("privacy").alias("chain"), "action"))
    out = steps.keep(decided(docs, pieces, local, judged, events, cases, circulated))
    return FullRun(docs, contexts, windows, local, found_c, every_p, results_c, results_p, frag_c, frag_p, judged, resolution, spans.targets(resolution), cases, events, out, steps)
