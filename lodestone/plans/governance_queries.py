"""Queries of the classic text run, of policies, scores and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import content, decisions, privacy, spans
from lodestone.plans import full_run, profiles
from lodestone.queries import query, table
from lodestone.ranks import CONTENT_RISK, code

# The SQL engine finds the same spans for the three rules that this corpus meets; offsets come from the pieces between matches.
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_CARD = r"(?:(?:62|[4569])\d[ -]?)(?:\d[ -]?){14,17}"
_SPAN = """SELECT doc_id, '{risk}' AS risk_type, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'm': m[i]}})) AS x
  FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS m, regexp_split_to_array(text, '{rx}') AS p FROM documents WHERE regexp_matches(text, '{rx}'))"""
_PHONE = r"(?:\+?86[-\s]?)?1[3-9]\d{9}"
_PII = (
    "WITH raw AS (" + " UNION ALL ".join(_SPAN.format(risk=r, rx=x) for r, x in (("email", _MAIL), ("bank_card", _CARD), ("phone_number", _PHONE)))
    + """), g AS (SELECT doc_id, risk_type, x.s::INTEGER AS start, (x.s + length(x.m))::INTEGER AS "end", x.m AS match FROM raw
  WHERE risk_type <> 'bank_card' OR NOT regexp_matches(regexp_replace(x.m, '\\D', '', 'g'), '""".replace("\\\\", "\\") + privacy.ID_CARD + """')),
f AS (SELECT * FROM g WHERE risk_type <> 'phone_number' OR NOT EXISTS (SELECT 1 FROM g h WHERE h.doc_id = g.doc_id AND h.risk_type IN ('bank_card', 'email')
  AND h.start <= g.start AND g."end" <= h."end" AND (h.start, h."end") <> (g.start, g."end"))),
j AS (SELECT doc_id FROM f WHERE risk_type IN ('bank_card', 'phone_number') GROUP BY doc_id HAVING count(DISTINCT risk_type) = 2) """
)


@query(_PII + 'SELECT doc_id, risk_type, start, "end", match FROM f')
def pii_postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return privacy.post_processed(privacy.recall(docs), docs).select("doc_id", "risk_type", "start", "end", "match")


@query()
def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.recall(table(spark, sf_dir, "documents")).drop("match")


# The corpus has no document with several kinds of identity data: numbers are added to some by their ids.
_NUMBERS = "WITH documents AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' 13812345678 ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' 6222021381234567890 ' ELSE '' END AS text FROM documents), "


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(d % 3 == 0, " 13812345678 ").otherwise(""), F.when(d % 2 == 0, " 6222021381234567890 ").otherwise("")).alias("text"))


@query(_NUMBERS + _PII.removeprefix("WITH ") + "SELECT doc_id, 'bank_card,phone_number' AS kinds, 'combined_identity' AS risk_type, 'critical' AS severity, 0.92::DOUBLE AS confidence FROM j")
def combined_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.post_processed(privacy.recall(numbered(spark, sf_dir)))
    return privacy.combined_identity(found).withColumn("kinds", F.array_join("kinds", ","))


@query(_NUMBERS + _PII.removeprefix("WITH ") + "SELECT risk_type, count(*) AS findings, count(DISTINCT doc_id) AS docs FROM raw GROUP BY risk_type")
def pii_recall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings before post-processing of the three rules that the corpus meets."""
    f = privacy.recall(numbered(spark, sf_dir)).filter(F.col("rule").isin("email", "bank_card", "phone_cn"))
    return f.groupBy("risk_type").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("docs"))


_RESULTS = """ , a AS (SELECT doc_id, count(*) AS n, max(CASE risk_type WHEN 'combined' THEN 0.92 WHEN 'bank_card' THEN 0.8 * 0.66 ELSE 0.8 * 0.88 END) AS s, bool_or(risk_type IN ('bank_card', 'combined')) AS need
  FROM (SELECT doc_id, risk_type FROM f UNION ALL SELECT doc_id, 'combined' FROM j) GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_findings, round(coalesce(s, 0), 4)::DOUBLE AS risk_score, coalesce(need, false) AS needs_adjudication,
  CASE WHEN n IS NULL THEN 'clear' WHEN need OR round(s, 4) BETWEEN 0.35 AND 0.85 THEN 'hard_case' ELSE 'flagged' END AS status FROM documents d LEFT JOIN a USING (doc_id)) """


@query(_PII + _RESULTS + "SELECT * FROM r")
def privacy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return privacy.document_results(docs, privacy.post_processed(privacy.recall(docs), docs))


@query(_PII + """ , t AS (SELECT doc_id, string_agg(match, '|' ORDER BY start) AS m FROM f GROUP BY doc_id)
SELECT doc_id, m AS spans, len(string_split(m, '|'))::INTEGER AS targets FROM t""")
def redaction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected spans, sliced out of the text; emails and cards never overlap in this corpus."""
    docs = table(spark, sf_dir, "documents")
    r = profiles.run(docs, "privacy_only").targets.join(docs.select("doc_id", "text"), "doc_id")
    cut = F.struct("start", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("m"))
    per = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(cut)).alias("x"))
    return per.select("doc_id", F.array_join(F.transform("x", lambda v: v["m"]), "|").alias("spans"), F.size("x").alias("targets"))


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{_MAIL}', '<EMAIL>', 'g'), '{_CARD}', '<BANK_CARD>', 'g'), '{_PHONE}', '<PHONE>', 'g')) AS redacted_sha256 FROM documents")
def redacted_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.run(table(spark, sf_dir, "documents"), "privacy_only").redacted().select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"))


@query()
def span_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among the raw findings: which finding was suppressed by which."""
    r = spans.resolved(privacy.recall(table(spark, sf_dir, "documents")))
    return r.select("doc_id", F.explode("lost").alias("x")).select("doc_id", F.col("x.o").alias("suppressed"), F.col("x.by").alias("selected"), F.col("x.why").alias("why"))


# The corpus has its own rude words; they stand for words of the pack, so that every severity is met.
WORDS = {"idiot": "bullying", "stupid": "how to make a bomb", "trash": "suicide"}


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(F.coalesce("text", F.lit("")))
    for a, b in WORDS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


_LOW = "lower(coalesce(text, ''))"
for _a, _b in WORDS.items():
    _LOW = f"replace({_LOW}, '{_a}', '{_b}')"
_DOCS = f"SELECT doc_id, {_LOW} AS low FROM documents"
_KW = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{v[0]}' AS policy_tag, '{v[2]}' AS severity, '{k}' AS keyword, (length(low) - length(replace(low, '{k}', ''))) // {len(k)} AS n FROM l WHERE contains(low, '{k}')" for c, v in content.PACK.items() for k in v[3])


@query(f"WITH l AS ({_DOCS}) SELECT category, policy_tag, severity, keyword, sum(n)::BIGINT AS hits, count(*) AS docs FROM ({_KW}) GROUP BY ALL")
def content_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = content.keyword_findings(worded(spark, sf_dir))
    return f.groupBy("category", "policy_tag", "severity", "keyword").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


# Spans of keywords from the pieces between them; a marker within 50 characters of a hit asks for adjudication.
_MET = ["bullying", "how to make a bomb", "bomb", "suicide"]
_OF = {k: (c, *v[:3]) for c, v in content.PACK.items() for k in v[3]}
_CSPAN = " UNION ALL ".join(
    f"""SELECT doc_id, low, '{k}' AS keyword, '{_OF[k][0]}' AS category, '{_OF[k][1]}' AS policy_tag, '{_OF[k][2]}' AS risk_type, '{_OF[k][3]}' AS severity, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(k)}))::INTEGER AS start, {len(k)} AS n
  FROM (SELECT doc_id, low, string_split(low, '{k}') AS p FROM l WHERE contains(low, '{k}'))""" for k in _MET
)
_MARK = " OR ".join(f"contains(near, '{m}')" for m in content.MARKERS)
_CONTENT = f"""WITH l AS ({_DOCS}), s AS ({_CSPAN}), h AS (SELECT *, start + n AS "end", substr(low, greatest(start - 50, 0) + 1, start + n + 50 - greatest(start - 50, 0)) AS near FROM s),
cf AS (SELECT doc_id, keyword, category, policy_tag, risk_type, severity, start, "end", {_MARK} AS need, CASE severity WHEN 'medium' THEN 0.65 WHEN 'high' THEN 0.9 ELSE 0.98 END AS base FROM h) """


@query(_CONTENT + """SELECT doc_id, keyword, policy_tag, severity, start, "end", need AS needs_adjudication, round(CASE WHEN need THEN greatest(0.35, base - 0.28) ELSE base END, 4)::DOUBLE AS confidence FROM cf""")
def content_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.keyword_findings(worded(spark, sf_dir)).select("doc_id", "keyword", "policy_tag", "severity", "start", "end", "needs_adjudication", "confidence")


_WEIGHT = "CASE severity WHEN 'medium' THEN 0.55 WHEN 'high' THEN 0.8 ELSE 1.0 END"


@query(_CONTENT + f""", a AS (SELECT doc_id, count(*) AS n, max({_WEIGHT} * round(CASE WHEN need THEN greatest(0.35, base - 0.28) ELSE base END, 4)) AS s, bool_or(need) AS need FROM cf GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_findings, round(coalesce(s, 0), 4)::DOUBLE AS risk_score, coalesce(need, false) AS needs_adjudication,
  CASE WHEN n IS NULL THEN 'clear' WHEN need OR round(s, 4) BETWEEN 0.35 AND 0.85 THEN 'hard_case' ELSE 'flagged' END AS status FROM documents d LEFT JOIN a USING (doc_id)""")
def content_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = worded(spark, sf_dir)
    return content.document_results(docs, content.keyword_findings(docs))


@query()
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = worded(spark, sf_dir)
    return content.candidate_windows(docs, content.keyword_findings(docs))


@query()
def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.packed_windows(table(spark, sf_dir, "documents"))


# Content of the run in SQL: a marker near a hit cannot be told without offsets, so the SQL covers the privacy profile.
_DECIDE = _RESULTS + """ , c AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM j) THEN 3 WHEN n_findings > 0 THEN 1 ELSE 0 END AS k FROM r WHERE status = 'hard_case'),
e AS (SELECT doc_id, max(CASE WHEN risk_type = 'bank_card' THEN 2 ELSE 1 END) AS fl FROM (SELECT doc_id, risk_type FROM f UNION ALL SELECT doc_id, 'combined' FROM f WHERE false) GROUP BY doc_id),
p AS (SELECT d.doc_id, greatest(coalesce(e.fl, 0), coalesce(c.k, 0)) AS p, c.k IS NOT NULL AS deg FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN c USING (doc_id)),
q AS (SELECT doc_id, 'P' || p AS disposition, CASE WHEN p < 2 THEN 'allow' WHEN p = 2 THEN 'quarantine' ELSE 'review' END AS decision,
  CASE p WHEN 0 THEN 0.05 WHEN 1 THEN 0.30 WHEN 2 THEN 0.55 ELSE 0.72 END::DOUBLE AS risk_score, CASE WHEN deg THEN 'degraded' ELSE 'full' END AS trust FROM p) """


@query(_PII + _DECIDE + "SELECT * FROM q")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.run(table(spark, sf_dir, "documents"), "privacy_only").decisions


@query(_PII + _DECIDE + """SELECT count(*) AS documents, """ + ", ".join(f"count(*) FILTER (disposition = 'P{k}') AS n_p{k}" for k in range(6)) + ", " + ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d}" for d in ("allow", "review", "quarantine", "reject")) + """,
  max(disposition) AS overall_disposition, CASE WHEN bool_or(decision = 'quarantine') THEN 'quarantine' WHEN bool_or(decision = 'review') THEN 'review' ELSE 'allow' END AS overall_decision,
  CASE WHEN bool_or(trust = 'degraded') THEN 'degraded' ELSE 'full' END AS trust FROM q""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.run(table(spark, sf_dir, "documents"), "privacy_only").summary()


@query()
def full_run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.run(table(spark, sf_dir, "documents"), "full").decisions


@query()
def hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.run(table(spark, sf_dir, "documents"), "full").cases


@query()
def evidence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all kinds: of findings, of both chains' assessments of every document, and of cases that have neither."""
    e = full_run.run(table(spark, sf_dir, "documents")).events
    return e.groupBy("category", "risk_type", "severity", "disputed").agg(F.count("*").alias("events"), F.max("confidence").alias("confidence"))


@query()
def annotation_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.run(table(spark, sf_dir, "documents"), "full").annotation()


# A finding of a label's severity for each labelled document, in integer arithmetic that both engines share.
_FIND = """SELECT doc_id, 0 AS ord, 'content.' || CASE doc_id % 3 WHEN 0 THEN 'violence' WHEN 1 THEN 'hate.group' ELSE 'hate' END AS policy_tag, (doc_id % 4)::INTEGER AS severity_rank FROM labels"""
_POLICIES = [("any", "content", 0, 1, "keep"), ("hate", "content.hate", 2, 50, "manual_review"), ("group", "content.hate.group", 1, 90, "reject"), ("violence", "content.violence", 3, 70, "reject")]


def label_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    tag = F.concat(F.lit("content."), F.when(i == 0, "violence").when(i == 1, "hate.group").otherwise("hate"))
    return table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("ord"), tag.alias("policy_tag"), (F.col("doc_id") % 4).cast("int").alias("severity_rank"))


@query(f"""WITH f AS ({_FIND}), p(policy_id, label, min_rank, priority, action) AS (VALUES {", ".join(str(p) for p in _POLICIES)})
SELECT doc_id, policy_tag, severity_rank, policy_id, action FROM (SELECT f.*, policy_id, action, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, policy_id) AS r
  FROM f LEFT JOIN p ON (policy_tag = label OR starts_with(policy_tag, label || '.')) AND severity_rank >= min_rank) WHERE r = 1""")
def content_policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame(_POLICIES, "policy_id string, label string, min_rank int, priority int, action string")
    return decisions.policy_join(label_findings(spark, sf_dir), policies).select("doc_id", "policy_tag", "severity_rank", "policy_id", "action")


@query("""SELECT custkey, max('C' || (k % 4)) AS risk, max('T' || (k % 3)) AS training, bool_and(k % 2 = 0) AS allow, bool_or(k % 5 = 0) AS review,
  max(k % 97) AS confidence, max_by('route' || (k % 6), k) AS route, string_agg(DISTINCT 'r' || (k % 4), ',' ORDER BY 'r' || (k % 4)) AS reasons
FROM (SELECT o_custkey AS custkey, o_orderkey AS k FROM orders) GROUP BY custkey""")
def content_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for findings of a customer's file: their key gives codes by integer arithmetic."""
    k = F.col("o_orderkey")
    mod = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    f = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), code((k % 4).cast("int"), CONTENT_RISK).alias("risk"), mod("T", 3).alias("training"), (k % 2 == 0).alias("allow"), (k % 5 == 0).alias("review"),
        (k % 97).alias("confidence"), mod("route", 6).alias("route"), k.alias("ord"), mod("r", 4).alias("reason"),
    )
    return decisions.governance(f).withColumnRenamed("doc_id", "custkey")


_COUNTS = """SELECT o_custkey AS custkey, count(*) FILTER (o_orderkey % 31 = 0) AS secrets, count(*) FILTER (o_orderkey % 17 = 0) AS unsafe, count(*) FILTER (o_orderkey % 7 = 0) AS controversial,
  count(*) FILTER (o_orderkey % 2 = 0) AS pii, count(*) FILTER (o_orderkey % 13 = 0) AS copyleft, count(*) AS hits, count(*) FILTER (o_orderkey % 11 = 0) AS degraded FROM orders GROUP BY o_custkey"""


@query(f"""SELECT custkey, least(s1, s2, s3, s4, s5)::DOUBLE AS least, round(0.3 * s1 + 0.25 * s2 + 0.2 * s3 + 0.15 * s4 + 0.1 * s5, 4)::DOUBLE AS weighted, fin AS final,
  CASE WHEN fin <= 0 THEN 'reject' WHEN fin <= 0.3 THEN 'quarantine' WHEN fin <= 0.6 THEN 'review' ELSE 'allow' END AS decision
FROM (SELECT *, round(greatest(least(s1, s2, s3, s4, s5) - least(0.3, degraded * 0.1), 0), 4)::DOUBLE AS fin FROM (SELECT *, CASE WHEN secrets > 0 THEN 0.0 ELSE 1 END::DOUBLE AS s1, CASE WHEN unsafe > 0 THEN 0 WHEN controversial > 0 THEN 0.5 ELSE 1 END::DOUBLE AS s2,
  CASE WHEN pii > 5 THEN 0.3 WHEN pii > 0 THEN 0.6 ELSE 1 END::DOUBLE AS s3, CASE WHEN copyleft > 0 THEN 0.5 ELSE 1 END::DOUBLE AS s4, CASE WHEN hits > 20 THEN 0.3 WHEN hits > 5 THEN 0.6 ELSE 1 END::DOUBLE AS s5 FROM ({_COUNTS})))""")
def five_dim_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = {"secrets": 31, "unsafe": 17, "controversial": 7, "pii": 2, "copyleft": 13, "degraded": 11}
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("hits"), *[F.count_if(k % m == 0).alias(x) for x, m in n.items()])
    return decisions.five_dimensions(c).select("custkey", "least", "weighted", "final", "decision")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'untrusted' WHEN bool_or(event_type = 'click') THEN 'partial' ELSE 'degraded' END AS trust FROM events GROUP BY user_id""")
def trust_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "mock").when(F.col("event_type") == "click", "critical").otherwise("other")
    return decisions.trust_level(table(spark, sf_dir, "events").select("user_id", kind.alias("kind")), "user_id")


_TASKS = "SELECT doc_id AS review_task_id, doc_id % 40 AS doc_id, doc_id AS finding_id, 'hold' AS action FROM labels"
_SUBS = "SELECT doc_id AS review_task_id, quality AS submitted, 'approve' AS review_decision, CASE WHEN toxic = 1 THEN 'reject' ELSE '' END AS final_action FROM labels WHERE doc_id % 3 <> 0"


@query(f"""WITH t AS ({_TASKS}), s AS ({_SUBS}), d AS (SELECT t.*, CASE WHEN s.final_action <> '' THEN s.final_action ELSE t.action END AS final, s.review_task_id IS NOT NULL AS done FROM t LEFT JOIN s USING (review_task_id))
SELECT doc_id, count(*) AS tasks, count(*) FILTER (done) AS reviewed, CASE WHEN bool_and(done) THEN 'complete' ELSE 'partial' END AS status FROM d GROUP BY doc_id""")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    tasks = lab.select(F.col("doc_id").alias("review_task_id"), (F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("finding_id"), F.lit("hold").alias("action"))
    subs = lab.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("review_task_id"), F.col("quality").alias("submitted"), F.lit("approve").alias("review_decision"), F.when(F.col("toxic") == 1, "reject").otherwise("").alias("final_action"))
    return decisions.review_status(decisions.reviewed(tasks, subs))


@query("SELECT doc_id, (doc_id % 6) BETWEEN toxic AND 3 + quality AS passed FROM labels")
def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    p = lambda c: F.concat(F.lit("P"), c.cast("string"))
    want = lab.select("doc_id", p(F.col("toxic")).alias("expected_min"), p(F.col("quality") + 3).alias("expected_max"))
    return decisions.evaluated(lab.select("doc_id", p(F.col("doc_id") % 6).alias("disposition")), want)


_TOOLS = ["label_studio", "doccano", "prodigy", "brat", "inception", "tagtog", "argilla"]


@query(f"SELECT tool, doc_id FROM labels, (SELECT unnest({_TOOLS}) AS tool) WHERE doc_id % 6 < 4")
def export_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.text_prep import export_gate

    lab = table(spark, sf_dir, "labels")
    d = F.concat(F.lit("P"), (F.col("doc_id") % 6).cast("string"))
    ok = lab.withColumn("reason", export_gate(F.lit("allow"), d, F.lit(True))).filter("reason is null")
    return decisions.export_items(ok, _TOOLS).select("tool", "doc_id")
