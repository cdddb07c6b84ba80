"""A whole text run on documents that meet both chains: rude words stand for words of the content pack, numbers are added by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans import full_run
from lodestone.plans.adjudication_queries import _CONTEXT
from lodestone.plans.governance_queries import _CONTENT, _LOW, _PII, WORDS
from lodestone.queries import query, table


def run_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("doc_id"), F.lower(F.coalesce("text", F.lit("")))
    for a, b in WORDS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    tail = F.concat(F.when(d % 3 == 0, " 13812345678 ").otherwise(""), F.when(d % 4 == 0, " 6222021381234567890 ").otherwise(""), F.when(d % 7 == 0, " textbook example. ").otherwise(""), F.when(d % 10 == 0, " grade list. ").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(t, tail).alias("text"))


# One SQL for the whole run: both recalls, context, fragments, assessments, cases, events and floors.
_RUN = f"""WITH documents AS (SELECT doc_id, {_LOW} || CASE WHEN doc_id % 3 = 0 THEN ' 13812345678 ' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' 6222021381234567890 ' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ' textbook example. ' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN ' grade list. ' ELSE '' END AS text FROM documents),
{_PII.removeprefix("WITH ")}, {_CONTENT.removeprefix("WITH ")},
ctx AS ({_CONTEXT}),
cc AS (SELECT cf.doc_id, risk_type, policy_tag, severity, round(CASE WHEN need THEN greatest(0.35, base - 0.28) ELSE base END, 4) AS confidence, ctx.document_type IN ('textbook_example', 'news_report') AS shielded FROM cf JOIN ctx ON cf.doc_id = ctx.doc_id),
pp AS (SELECT p.*, document_type AS t, minor FROM (SELECT doc_id, risk_type, 'pii.' || risk_type AS tag, CASE risk_type WHEN 'bank_card' THEN 0.66 ELSE 0.88 END AS confidence FROM f UNION ALL SELECT doc_id, 'combined_identity', 'pii.combined_identity', 0.92 FROM j) p JOIN ctx ON p.doc_id = ctx.doc_id),
pa AS (SELECT *, CASE risk_type WHEN 'combined_identity' THEN 'manual_review' ELSE 'redact' END AS action FROM pp),
ac AS (SELECT d.doc_id, 'content' AS chain, CASE WHEN n IS NULL THEN 'keep' ELSE 'manual_review' END AS action, n IS NOT NULL AS may, CASE WHEN n IS NULL THEN 0.92 ELSE 0.74 END AS confidence, n IS NOT NULL AS review FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM cc GROUP BY doc_id) x ON d.doc_id = x.doc_id),
ap AS (SELECT d.doc_id, 'privacy' AS chain, CASE WHEN n IS NULL THEN 'keep' WHEN c THEN 'exclude_from_training' ELSE 'redact' END AS action, n IS NOT NULL AS may, CASE WHEN n IS NULL THEN 0.92 ELSE 0.72 END AS confidence, false AS review
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, bool_or(risk_type = 'combined_identity') AS c FROM pp GROUP BY doc_id) x ON d.doc_id = x.doc_id),
aa AS (FROM ac UNION ALL FROM ap),
st AS (SELECT doc_id, max(CASE risk_type WHEN 'combined_identity' THEN 0.92 WHEN 'bank_card' THEN 0.8 * 0.66 ELSE 0.8 * 0.88 END) AS s, bool_or(risk_type IN ('bank_card', 'combined_identity')) AS need, count(*) AS n, bool_or(risk_type = 'combined_identity') AS joint FROM pp GROUP BY doc_id),
hc AS (SELECT d.doc_id, x.doc_id IS NOT NULL AS c, st.doc_id IS NOT NULL AS p, coalesce(joint, false) AS joint FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM cc) x ON d.doc_id = x.doc_id LEFT JOIN st ON d.doc_id = st.doc_id
  WHERE x.doc_id IS NOT NULL OR (st.doc_id IS NOT NULL AND (need OR round(s, 4) BETWEEN 0.35 AND 0.85))),
hk AS (SELECT doc_id, CASE WHEN c OR joint THEN 3 WHEN p THEN 1 ELSE 0 END AS k, c OR joint AS review, round(least(CASE WHEN c THEN 0.58 ELSE 0.92 END, CASE WHEN joint THEN 0.57 WHEN p THEN 0.76 ELSE 1.0 END), 4)::DOUBLE AS confidence FROM hc),
ev AS (SELECT x.doc_id, category, risk_type, policy_tag, severity, x.confidence, coalesce(hk.review, false) AS disputed FROM (SELECT doc_id, 'content_safety' AS category, risk_type, policy_tag, severity, confidence FROM cc
    UNION ALL SELECT doc_id, 'privacy', risk_type, tag, CASE risk_type WHEN 'combined_identity' THEN 'critical' ELSE 'high' END, confidence FROM pp) x LEFT JOIN hk ON x.doc_id = hk.doc_id
  UNION ALL SELECT doc_id, chain || '_document', chain || '_document_assessment', chain || '.document_assessment', CASE WHEN review THEN 'medium' ELSE 'low' END, confidence, review FROM aa),
fl AS (SELECT doc_id, CASE action WHEN 'redact' THEN 1 WHEN 'generalize' THEN 2 WHEN 'manual_review' THEN 3 ELSE 0 END AS k FROM pa UNION ALL SELECT doc_id, CASE WHEN shielded THEN 2 ELSE 3 END FROM cc
  UNION ALL SELECT doc_id, CASE action WHEN 'keep' THEN 0 WHEN 'redact' THEN 1 ELSE 3 END FROM aa WHERE may UNION ALL SELECT doc_id, k FROM hk),
dd AS (SELECT d.doc_id, 'P' || coalesce(k, 0) AS disposition, n AS n_events, tags, CASE WHEN hk IS NULL THEN 'full' ELSE 'degraded' END AS trust, hk IS NOT NULL AS routed, coalesce(nl, 0) AS nl FROM documents d LEFT JOIN (SELECT doc_id, max(k) AS k FROM fl GROUP BY doc_id) x ON d.doc_id = x.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n, list(DISTINCT policy_tag) AS tags FROM ev GROUP BY doc_id) y ON d.doc_id = y.doc_id LEFT JOIN (SELECT doc_id AS h, true AS hk FROM hk) z ON d.doc_id = z.h LEFT JOIN (SELECT doc_id, count(*) AS nl FROM cc GROUP BY doc_id) w ON d.doc_id = w.doc_id),
de AS (SELECT doc_id, disposition, CASE disposition WHEN 'P2' THEN 'quarantine' WHEN 'P3' THEN 'review' ELSE 'allow' END AS decision, CASE disposition WHEN 'P0' THEN 0.05 WHEN 'P1' THEN 0.30 WHEN 'P2' THEN 0.55 ELSE 0.72 END::DOUBLE AS risk_score,
  CASE disposition WHEN 'P0' THEN 'release' WHEN 'P1' THEN 'apply_redaction,release' WHEN 'P2' THEN 'apply_redaction,restrict_internal_access,hold_external_delivery' ELSE 'manual_review_required,hold_delivery' END AS actions,
  CASE disposition WHEN 'P2' THEN 'normal' WHEN 'P3' THEN 'high' ELSE 'low' END AS priority, n_events, trust, nl, routed,
  array_to_string(list_sort(list_concat(list_concat(tags, (SELECT list(chain || '_doc:' || action) FROM aa WHERE aa.doc_id = dd.doc_id)), list_concat(CASE WHEN nl > 0 THEN ['content_localized_fragments:' || nl] ELSE [] END, CASE WHEN routed THEN ['hard_case:heuristic'] ELSE [] END))), ',') AS reasons FROM dd)
"""


@query(_RUN + "SELECT doc_id, disposition, decision, risk_score, actions, priority, reasons, n_events, trust FROM de")
def run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = full_run.run(run_docs(spark, sf_dir))
    return r.decisions.select("doc_id", "disposition", "decision", "risk_score", "actions", "priority", "reasons", "n_events", "trust")


@query(_RUN + "SELECT category, risk_type, policy_tag, severity, disputed, count(*) AS events, round(max(confidence), 4)::DOUBLE AS confidence FROM ev GROUP BY ALL")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = full_run.run(run_docs(spark, sf_dir))
    return r.events.groupBy("category", "risk_type", "policy_tag", "severity", "disputed").agg(F.count("*").alias("events"), F.round(F.max("confidence"), 4).alias("confidence"))


@query(_RUN + """SELECT de.doc_id, disposition, decision, reasons, n_events, trust, nl AS n_localised, nl AS n_content_fragments, (SELECT count(*) FROM pp WHERE pp.doc_id = de.doc_id) AS n_privacy_fragments, document_type, minor,
  CASE WHEN nl > 0 THEN 'hard_case' ELSE 'clear' END AS content_status, CASE WHEN st.doc_id IS NULL THEN 'clear' WHEN need OR round(s, 4) BETWEEN 0.35 AND 0.85 THEN 'hard_case' ELSE 'flagged' END AS privacy_status, ac.action AS content_action, ap.action AS privacy_action,
  CASE WHEN routed THEN 'heuristic' ELSE '' END AS hard_case_provider, disposition || ' / ' || decision || ' with ' || n_events || ' evidence events.' AS audit_summary
FROM de JOIN ctx ON de.doc_id = ctx.doc_id JOIN ac ON de.doc_id = ac.doc_id JOIN ap ON de.doc_id = ap.doc_id LEFT JOIN st ON de.doc_id = st.doc_id""")
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit package, but for windows, targets and scores, which other queries have."""
    return full_run.run(run_docs(spark, sf_dir)).audit().drop("n_windows", "n_targets", "content_score", "privacy_score")


@query(_RUN + """SELECT de.doc_id, CASE disposition WHEN 'P2' THEN 'hold' WHEN 'P3' THEN 'hold' ELSE 'deliver' END AS delivery, disposition, decision, priority, (SELECT count(*) FROM f WHERE f.doc_id = de.doc_id) AS n_targets,
  array_to_string(list_sort((SELECT list(DISTINCT policy_tag) FROM ev WHERE ev.doc_id = de.doc_id))[1:5], ',') AS hints,
  sha256(regexp_replace(regexp_replace(regexp_replace(text, '""" + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + "', '<EMAIL>', 'g'), '" + r"(?:(?:62|[4569])\d[ -]?)(?:\d[ -]?){14,17}" + "', '<BANK_CARD>', 'g'), '" + r"(?:\+?86[-\s]?)?1[3-9]\d{9}" + """', '<PHONE>', 'g')) AS redacted_sha256
FROM de JOIN documents ON de.doc_id = documents.doc_id""")
def run_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = full_run.run(run_docs(spark, sf_dir)).annotation()
    return a.select("doc_id", "delivery", "disposition", "decision", "priority", "n_targets", "hints", F.sha2("redacted", 256).alias("redacted_sha256"))
