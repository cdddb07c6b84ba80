"""The run profiles: which chains of a text run are active."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import content, decisions, privacy, spans


@dataclass
class Run:
    """All tables of a text run; each is lazy."""

    docs: DataFrame
    content: DataFrame
    privacy: DataFrame
    content_results: DataFrame
    privacy_results: DataFrame
    resolution: DataFrame
    targets: DataFrame
    cases: DataFrame
    events: DataFrame
    decisions: DataFrame

    def redacted(self) -> DataFrame:
        return spans.redacted(self.docs, self.targets)

    def summary(self) -> DataFrame:
        return decisions.run_summary(self.decisions)

    def annotation(self) -> DataFrame:
        """doc_id, disposition, decision, n_targets, priority, skip_reason, redacted text hash."""
        from lodestone.operators.text_prep import export_gate

        n = self.targets.groupBy("doc_id").agg(F.count("*").alias("n_targets"))
        d = self.decisions.join(n, "doc_id", "left").join(self.redacted(), "doc_id")
        urgent = F.when(F.col("disposition").isin("P4", "P5"), "critical").when(F.col("disposition") == "P3", "high").when(F.col("disposition") == "P2", "normal").otherwise("low")
        reason = export_gate(F.col("decision"), F.col("disposition"), F.lit(False))
        return d.select("doc_id", "disposition", "decision", F.coalesce("n_targets", F.lit(0)).cast("bigint").alias("n_targets"), urgent.alias("priority"), reason.alias("skip_reason"), F.sha2("redacted", 256).alias("redacted_sha256"))


def run(docs: DataFrame, profile: str = "full") -> Run:
    """full, privacy_only or safety_only; an inactive chain is an empty table, so its scan is not planned."""
    if profile not in ("full", "privacy_only", "safety_only"):
        raise ValueError(profile)
    found_c = content.keyword_findings(docs)
    # its findings are compared with each other, so without this each side would run the kernel
    found_p = privacy.post_processed(privacy.recall(docs).persist(), docs)
    if profile == "privacy_only":
        found_c = found_c.filter(F.lit(False))
    if profile == "safety_only":
        found_p = found_p.filter(F.lit(False))
    # read by several steps each; the kernel runs once
    found_c, found_p = found_c.persist(), found_p.persist()
    results_c, results_p = content.document_results(docs, found_c), privacy.document_results(docs, found_p)
    combined = privacy.combined_identity(found_p).select("doc_id", "risk_type", "severity", "confidence")
    every_p = found_p.select("doc_id", "risk_type", "severity", "confidence").unionByName(combined)
    cases = decisions.hard_cases(docs, found_c, every_p, results_c, results_p)
    events = decisions.evidence_events(found_c, every_p, cases)
    resolution = spans.resolved(found_p)
    return Run(docs, found_c, found_p, results_c, results_p, resolution, spans.targets(resolution), cases, events, decisions.policy_decisions(docs, events, cases))
