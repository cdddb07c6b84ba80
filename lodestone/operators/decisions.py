"""From findings to dispositions: hard cases, events, floors, packages, summaries, scores and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.ranks import DECISION_RUN, DISPOSITION, DISPOSITION_DECISION, DISPOSITION_RISK, code, lookup, rank
from lodestone.tables import merged


def hard_cases(docs: DataFrame, content: DataFrame, privacy: DataFrame, content_results: DataFrame, privacy_results: DataFrame) -> DataFrame:
    """Documents routed to the second adjudicator, with the heuristic's judgement.

    doc_id, content_status, privacy_status, confidence, recommended, requires_manual_review.
    """
    c = content.groupBy("doc_id").agg(F.bool_or((F.col("severity") == "critical") & ~F.col("needs_adjudication")).alias("certain"), F.count("*").alias("nc"))
    kinds = privacy.groupBy("doc_id").agg(F.bool_or(F.col("risk_type") == "combined_identity").alias("combined"), F.count("*").alias("np"))
    routed = content_results.filter("status = 'hard_case'").select("doc_id").union(privacy_results.filter("status = 'hard_case'").select("doc_id")).distinct()
    j = merged(merged(routed, c, "doc_id", "left"), kinds, "doc_id", "left").fillna(0, ["nc", "np"]).fillna(False, ["certain", "combined"])
    has_c, has_p = F.col("nc") > 0, F.col("np") > 0
    unsafe = has_c & F.col("certain")
    border = has_c & ~F.col("certain")
    joint = has_p & F.col("combined")
    recommended = F.greatest(F.when(unsafe, 4).when(border, 3).otherwise(0), F.when(joint, 3).when(has_p, 1).otherwise(0))
    confidence = F.least(F.when(unsafe, 0.88).when(border, 0.58).otherwise(0.92), F.when(joint, 0.57).when(has_p, 0.76).otherwise(1.0))
    return j.select(
        "doc_id",
        F.when(unsafe, "unsafe").when(border, "borderline").otherwise("clear").alias("content_status"),
        F.when(joint, "borderline").when(has_p, "contains_pii").otherwise("clear").alias("privacy_status"),
        F.round(confidence, 4).alias("confidence"),
        code(recommended, DISPOSITION).alias("recommended"),
        (border | joint).alias("requires_manual_review"),
    )


def evidence_events(content: DataFrame, privacy: DataFrame, cases: DataFrame) -> DataFrame:
    """doc_id, category, risk_type, severity, confidence, disputed: one event a finding, and one for a case without findings."""
    pick = ["doc_id", "risk_type", "severity", "confidence"]
    found = content.select(*pick, F.lit("content_safety").alias("category")).unionByName(privacy.select(*pick, F.lit("privacy").alias("category")))
    out = merged(found, cases.select("doc_id", "requires_manual_review"), "doc_id", "left").withColumn("disputed", F.coalesce("requires_manual_review", F.lit(False))).drop("requires_manual_review")
    alone = merged(cases, found.select("doc_id").distinct(), "doc_id", "left_anti")
    alone = alone.select("doc_id", F.lit("adjudication_only").alias("risk_type"), F.lit("medium").alias("severity"), "confidence", F.lit("hard_case").alias("category"), F.col("requires_manual_review").alias("disputed"))
    return out.unionByName(alone)


def event_floor(category: Column, risk: Column, severity: Column, disputed: Column) -> Column:
    """Least disposition rank that an event asks for."""
    content = F.when(disputed, 3).when(severity.isin("critical", "high"), 4).when(severity == "medium", 3).otherwise(1)
    privacy = F.when(risk.isin("combined_identity", "api_unavailable"), F.when(disputed, 3).otherwise(2)).when(risk.isin("id_card", "bank_card"), 2).when(risk.isin("address", "student_id", "parent_contact") & disputed, 2).otherwise(1)
    return F.when(category == "content_safety", content).otherwise(privacy)


def policy_decisions(docs: DataFrame, events: DataFrame, cases: DataFrame, circulated: Column | None = None) -> DataFrame:
    """doc_id, disposition, decision, risk_score, trust of every document: the highest of event floors and the case's recommendation."""
    floors = events.groupBy("doc_id").agg(F.max(event_floor(F.col("category"), F.col("risk_type"), F.col("severity"), F.col("disputed"))).alias("floor"))
    case = cases.select("doc_id", rank(F.col("recommended"), DISPOSITION).alias("case"))
    top = F.greatest(F.coalesce("floor", F.lit(0)), F.coalesce("case", F.lit(0)))
    if circulated is not None:
        top = F.when((top == 4) & circulated, 5).otherwise(top)
    out = merged(merged(docs.select("doc_id"), floors, "doc_id", "left"), case, "doc_id", "left").withColumn("disposition", code(top, DISPOSITION))
    d = F.col("disposition")
    return out.select("doc_id", "disposition", lookup(d, DISPOSITION_DECISION).alias("decision"), lookup(d, DISPOSITION_RISK).alias("risk_score"), F.when(F.col("case").isNotNull(), "degraded").otherwise("full").alias("trust"))


def run_summary(decisions: DataFrame) -> DataFrame:
    """One row: documents, counts by disposition and decision, the highest of either order, and trust."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v.lower()}")
    top = F.max(rank(F.col("disposition"), DISPOSITION)), F.max(rank(F.col("decision"), DECISION_RUN))
    return decisions.agg(
        F.count("*").alias("documents"),
        *[count("disposition", v) for v in DISPOSITION],
        *[count("decision", v) for v in DECISION_RUN],
        code(F.coalesce(top[0], F.lit(0)), DISPOSITION).alias("overall_disposition"),
        code(F.coalesce(top[1], F.lit(0)), DECISION_RUN).alias("overall_decision"),
        F.when(F.bool_or(F.col("trust") == "degraded"), "degraded").otherwise("full").alias("trust"),
    )


def trust_level(events: DataFrame, key: str) -> DataFrame:
    """Trust of each run from its degrade events (kind: mock, critical or other)."""
    return events.groupBy(key).agg(F.when(F.bool_or(F.col("kind") == "mock"), "untrusted").when(F.bool_or(F.col("kind") == "critical"), "partial").when(F.count("kind") > 0, "degraded").otherwise("full").alias("trust"))


def five_dimensions(counts: DataFrame) -> DataFrame:
    """Scores from counts per document (secrets, unsafe, controversial, pii, copyleft, hits, degraded): each dimension, the least, the weighted mean, the decision.

    The least decides; the weighted mean is reported.
    """
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("secrets", "unsafe", "controversial", "pii", "copyleft", "hits", "degraded")}
    s = {
        "s_secrets": F.when(c["secrets"] > 0, 0.0).otherwise(1.0),
        "s_safety": F.when(c["unsafe"] > 0, 0.0).when(c["controversial"] > 0, 0.5).otherwise(1.0),
        "s_privacy": F.when(c["pii"] > 5, 0.3).when(c["pii"] > 0, 0.6).otherwise(1.0),
        "s_compliance": F.when(c["copyleft"] > 0, 0.5).otherwise(1.0),
        "s_text": F.when(c["hits"] > 20, 0.3).when(c["hits"] > 5, 0.6).otherwise(1.0),
    }
    out = counts.withColumns(s)
    least = F.least(*[F.col(n) for n in s])
    mean = sum((F.col(n) * w for n, w in zip(s, (0.3, 0.25, 0.2, 0.15, 0.1))), F.lit(0.0))
    out = out.withColumn("least", least).withColumn("weighted", F.round(mean, 4))
    final = F.greatest(F.col("least") - F.least(F.lit(0.3), c["degraded"] * 0.1), F.lit(0.0))
    return out.withColumn("final", F.round(final, 4)).withColumn("decision", F.when(F.col("final") <= 0.0, "reject").when(F.col("final") <= 0.3, "quarantine").when(F.col("final") <= 0.6, "review").otherwise("allow"))


def policy_join(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy of highest priority for each finding: its label equals or extends the policy's, and is severe enough; nothing else matches.

    Policies are a small rule table (columns policy_id, label, min_rank, priority, action); it is broadcast.
    """
    p = F.broadcast(policies)
    label = (F.col("policy_tag") == F.col("label")) | F.col("policy_tag").startswith(F.concat("label", F.lit(".")))
    j = findings.join(p, label & (F.col("severity_rank") >= F.col("min_rank")), "left")
    w = Window.partitionBy("doc_id", "ord").orderBy(F.col("priority").desc_nulls_last(), "policy_id")
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "label", "min_rank")


def reviewed(tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """Tasks with the last submission of each: its decision overrides where given, else the current one is inherited."""
    last = submissions.groupBy("review_task_id").agg(F.max_by(F.struct("review_decision", "final_action"), "submitted").alias("s"))
    j = tasks.join(last, "review_task_id", "left")
    final = F.coalesce(F.when(F.trim(F.col("s.final_action")) != "", F.col("s.final_action")), F.col("action"))
    return j.select("review_task_id", "doc_id", "finding_id", final.alias("action"), F.when(F.col("s").isNotNull(), "reviewed").otherwise("pending").alias("status"))


def review_status(done: DataFrame) -> DataFrame:
    """doc_id, tasks, reviewed, status: complete once every task is reviewed."""
    return done.groupBy("doc_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "reviewed").alias("reviewed")).withColumn("status", F.when(F.col("tasks") == F.col("reviewed"), "complete").otherwise("partial"))


def governance(findings: DataFrame) -> DataFrame:
    """Roll-up of findings (risk C, action, training T, allow, review, confidence, route, ord): highest codes, but the last finding's route."""
    return findings.groupBy("doc_id").agg(
        F.max("risk").alias("risk"), F.max("training").alias("training"), F.bool_and("allow").alias("allow"), F.bool_or("review").alias("review"),
        F.max("confidence").alias("confidence"), F.max_by("route", "ord").alias("route"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def export_items(annotations: DataFrame, tools: list[str]) -> DataFrame:
    """A row for each tool and exportable document; the reason of those left out."""
    t = F.explode(F.array(*[F.lit(x) for x in tools])).alias("tool")
    return annotations.select("*", t)


def evaluated(decisions: DataFrame, expected: DataFrame, order: list[str] = DISPOSITION) -> DataFrame:
    """Expected ranges against results: doc_id, passed."""
    r = rank(F.col("disposition"), order)
    ok = (r >= rank(F.coalesce("expected_min", F.lit(order[0])), order)) & (r <= rank(F.coalesce("expected_max", F.lit(order[-1])), order))
    return expected.join(decisions, "doc_id", "left").select("doc_id", F.coalesce(ok, F.lit(False)).alias("passed"))
