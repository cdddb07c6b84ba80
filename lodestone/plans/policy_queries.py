"""Queries of the policy engines; findings are made of labelled documents by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import content, policies
from lodestone.queries import query, table

_TAGS = [(v[0], v[1]) for v in content.PACK.values()] + [("content.other", "other")]
_SEVERITIES = ["low", "medium", "high", "critical"]
_CONTEXT = ["education", "chat", "news", ""]
_AUDIENCE = ["minor", "general", "student", "", "general", "teacher"]
_USE = ["training_candidate", "annotation", "model_training", "", "training"]
_CUSTOM = {"content.violent": "P5", "harassment": "P4", "content.misleading.pseudo_authority.school": "P3"}
_RISKS = [*policies.CATALOG, "phone", "api_key", "location", "psychological_record", "crypto_wallet", "credential_id"]
_ENTITY = {"email": "restricted_review", "person_name": "retain", "address": "drop_or_manual_review"}


def pick(names: list[str], k):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))


def content_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two findings of each labelled document."""
    d = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    k = F.col("doc_id") * 3 + F.col("ord") * 5
    return d.select(
        "doc_id", "ord", pick([t for t, _ in _TAGS], k % len(_TAGS)).alias("policy_tag"), pick([r for _, r in _TAGS], k % len(_TAGS)).alias("risk_type"), pick(_SEVERITIES, (k + F.floor(k / 7)) % 4).alias("severity"),
        pick(_CONTEXT, k % 4).alias("context_type"), pick(_AUDIENCE, k % 6).alias("audience"), pick(_USE, k % 5).alias("downstream_use"), (k % 7 == 0).alias("needs_adjudication"),
        F.when(k % 5 == 0, "context").otherwise("").alias("sem_decision"), (k % 15 == 5).alias("sem_upgrade"), (k % 10 == 0).alias("sem_downgrade"), F.concat(F.lit("C"), (k % 4).cast("string")).alias("sem_risk"),
        F.concat(F.lit("P"), (k % 6).cast("string")).alias("sem_action"), F.concat(F.lit("T"), (k % 4).cast("string")).alias("sem_training"), F.when(k % 3 == 0, "special").otherwise("").alias("sem_route"),
    )


_F = f"""SELECT doc_id, ord, {[t for t, _ in _TAGS]}[k % {len(_TAGS)} + 1] AS policy_tag, {[r for _, r in _TAGS]}[k % {len(_TAGS)} + 1] AS risk_type, {_SEVERITIES}[(k + k // 7) % 4 + 1] AS severity, {_CONTEXT}[k % 4 + 1] AS context_type,
  {_AUDIENCE}[k % 6 + 1] AS audience, {_USE}[k % 5 + 1] AS downstream_use, k % 7 = 0 AS need, k % 5 = 0 AS said, k % 15 = 5 AS up, k % 10 = 0 AS dn, 'C' || (k % 4) AS sr, 'P' || (k % 6) AS sa, 'T' || (k % 4) AS st, CASE WHEN k % 3 = 0 THEN 'special' ELSE '' END AS so
  FROM (SELECT doc_id, ord, doc_id * 3 + ord * 5 AS k FROM labels, (VALUES (0), (1)) o(ord))"""


def _sql(v) -> str:
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return (str(v) if v else "[]") + "::VARCHAR[]"
    return repr(v)


_CP = "(VALUES " + ", ".join("(" + ", ".join(_sql(x) for x in (*r, k)) + ")" for k, r in enumerate(policies.CONTENT_POLICIES)) + ") p(policy_id, labels, least, contexts, p_audience, priority, p_risk, p_action, p_training, p_route, p_allow, p_review, nth)"
_HITS = f"""SELECT f.*, p.* FROM ({_F}) f LEFT JOIN {_CP} ON (len(labels) = 0 OR len(list_filter(labels, lambda l: policy_tag = l OR starts_with(policy_tag, l || '.') OR risk_type = l OR starts_with(risk_type, l || '.'))) > 0)
  AND list_position({_SEVERITIES}, severity) >= list_position({_SEVERITIES}, least) AND (len(contexts) = 0 OR list_contains(contexts, context_type)) AND (p_audience = '' OR p_audience = audience)"""
_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY priority DESC NULLS LAST, nth) AS r FROM ({_HITS})) WHERE r = 1"


@query(f"SELECT doc_id, ord, policy_id, priority FROM ({_HITS})")
def content_policy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policies.rule_table(spark, policies.CONTENT_POLICIES, policies.CONTENT_KIND)
    return policies.content_policy_hits(content_findings(spark, sf_dir), p).select("doc_id", "ord", "policy_id", "priority")


@query(f"SELECT doc_id, string_agg(policy_id, ',' ORDER BY p DESC, n) AS policies FROM (SELECT doc_id, policy_id, max(priority) AS p, min(nth) AS n FROM ({_HITS}) WHERE policy_id IS NOT NULL GROUP BY ALL) GROUP BY doc_id")
def content_policy_hits_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policies.rule_table(spark, policies.CONTENT_POLICIES, policies.CONTENT_KIND)
    return policies.distinct_hits(policies.content_policy_hits(content_findings(spark, sf_dir), p))


_G = {n: "CASE {a} " + " ".join(f"WHEN '{k}' THEN {_sql(v[i])}" for k, v in policies.GOVERNED.items()) + " END" for i, n in enumerate(("risk", "training", "route", "allow", "review"))}
_own = ", ".join(f"CASE WHEN " + " OR ".join(f"{c} = '{k}' OR starts_with({c}, '{k}.') OR starts_with('{k}', {c} || '.')" for c in ("policy_tag", "risk_type")) + f" THEN '{v}' END" for k, v in _CUSTOM.items())
_D0 = f"""SELECT *, policy_id IS NOT NULL AS met, CASE WHEN severity IN ('critical', 'high') THEN 'P4' WHEN need OR severity = 'medium' THEN 'P3' ELSE 'P2' END AS b, audience IN ('minor', 'student') AS young,
  regexp_matches(policy_tag || ' ' || risk_type, 'minor_harmful|self_harm|sexual exploitation|child') AS strict, list_max([{_own}]) AS own FROM ({_TOP})"""
_D1 = "SELECT *, CASE WHEN met THEN p_action ELSE b END AS action, " + ", ".join(f"CASE WHEN met THEN p_{n} ELSE {_G[n].format(a='b')} END AS {n}" for n in _G) + f" FROM ({_D0})"
_D2 = f"""SELECT * REPLACE (CASE WHEN dn2 THEN CASE WHEN sr = 'C3' THEN 'C3' ELSE 'C2' END WHEN up2 THEN greatest(risk, sr) ELSE risk END AS risk, CASE WHEN dn2 THEN 'P3' WHEN up2 THEN greatest(action, sa) ELSE action END AS action,
  CASE WHEN dn2 THEN 'T2' WHEN up2 THEN greatest(training, st) ELSE training END AS training, CASE WHEN dn2 THEN CASE WHEN so <> '' THEN so ELSE 'safety_review_or_eval_only' END WHEN up2 AND so <> '' AND sa >= action THEN so ELSE route END AS route,
  CASE WHEN dn2 THEN false ELSE allow END AS allow, CASE WHEN dn2 THEN true ELSE review END AS review) FROM (SELECT *, said AND up AS up2, said AND NOT up AND dn AND NOT young AND NOT strict AS dn2 FROM ({_D1}))"""
_D3 = f"SELECT * REPLACE (CASE WHEN y THEN 'C3' ELSE risk END AS risk, CASE WHEN y THEN 'P4' ELSE action END AS action, CASE WHEN y THEN 'T3' ELSE training END AS training, CASE WHEN y THEN 'exclude_from_training' ELSE route END AS route, allow AND NOT y AS allow, review AND NOT y AS review) FROM (SELECT *, young AND severity IN ('high', 'critical') AS y FROM ({_D2}))"
_D4 = f"""SELECT * REPLACE (CASE WHEN own IS NULL THEN risk ELSE greatest(risk, {_G['risk'].format(a='own')}) END AS risk, CASE WHEN own IS NULL THEN action ELSE greatest(action, own) END AS action,
  CASE WHEN own IS NULL THEN training ELSE greatest(training, {_G['training'].format(a='own')}) END AS training, CASE WHEN own >= action THEN {_G['route'].format(a='own')} ELSE route END AS route,
  allow AND coalesce({_G['allow'].format(a='own')}, true) AS allow, review OR coalesce({_G['review'].format(a='own')}, false) AS review) FROM ({_D3})"""
_CD = f"SELECT doc_id, ord, policy_id, risk, action, training, route, allow AND NOT (downstream_use IN ('training_candidate', 'model_training', 'pretraining') AND action IN ('P3', 'P4')) AS allow, review FROM ({_D4})"


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.content_decisions(content_findings(spark, sf_dir), policies.rule_table(spark, policies.CONTENT_POLICIES, policies.CONTENT_KIND), _CUSTOM)


@query(_CD)
def content_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir)


_SAID = "Exclude hate speech and anything violent, please"
_TEXT = f"""SELECT * REPLACE (CASE WHEN y2 THEN 'C3' ELSE risk END AS risk, CASE WHEN y2 THEN greatest(action, 'P4') ELSE action END AS action, CASE WHEN y2 THEN 'T3' ELSE training END AS training, CASE WHEN y2 AND action <= 'P4' THEN 'exclude_from_training' ELSE route END AS route, allow AND NOT y2 AS allow)
  FROM (SELECT *, contains(lower(policy_tag || ' ' || risk_type), 'hate') OR contains(lower(policy_tag || ' ' || risk_type), 'violent') AS y2 FROM ({_D3}))"""


@query(_CD.replace(f"({_D3})", f"({_TEXT})"))
def text_policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content decisions under a policy in plain text as well."""
    return policies.content_decisions(content_findings(spark, sf_dir), policies.rule_table(spark, policies.CONTENT_POLICIES, policies.CONTENT_KIND), _CUSTOM, _SAID)


@query(f"""SELECT d.doc_id, coalesce(max(risk), 'C0') AS risk, coalesce(max(action), 'P0') AS action, coalesce(max(training), 'T0') AS training, coalesce(arg_max(route, ord), 'general_training') AS route, coalesce(bool_and(allow), true) AS allow,
  coalesce(bool_or(review), false) AS review, count(ord) AS findings FROM documents d LEFT JOIN ({_CD}) c USING (doc_id) GROUP BY d.doc_id""")
def content_governance_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.content_governance(table(spark, sf_dir, "documents"), _content(spark, sf_dir))


def privacy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    k = F.col("doc_id") * 5 + F.col("ord") * 11
    return d.select(
        "doc_id", "ord", pick(_RISKS, k % len(_RISKS)).alias("risk_type"), pick(_SEVERITIES, (k + F.floor(k / 3)) % 4).alias("severity"), (k % 6 == 0).alias("minor"), (k % 7 == 0).alias("needs_adjudication"),
        pick(["student", "adult", "", "minor", "teacher"], k % 5).alias("subject_type"), pick(["training", "annotation", "", "research"], k % 4).alias("purpose"),
    )


_PF = f"""SELECT doc_id, ord, {_RISKS}[k % {len(_RISKS)} + 1] AS risk_type, {_SEVERITIES}[(k + k // 3) % 4 + 1] AS severity, k % 6 = 0 AS minor, k % 7 = 0 AS need, ['student', 'adult', '', 'minor', 'teacher'][k % 5 + 1] AS subject_type,
  ['training', 'annotation', '', 'research'][k % 4 + 1] AS purpose FROM (SELECT doc_id, ord, doc_id * 5 + ord * 11 AS k FROM labels, (VALUES (0), (1)) o(ord))"""
_ALIAS = {"phone": "phone_number", "api_key": "secret", "location": "address", "psychological_record": "medical_record", "credential_id": "id_card"}
_E0 = f"SELECT *, CASE risk_type {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _ALIAS.items())} ELSE risk_type END AS entity FROM ({_PF})"
_cat = lambda i, other: "CASE entity " + " ".join(f"WHEN '{n}' THEN '{v[i]}'" for n, v in policies.CATALOG.items()) + f" ELSE {other} END"
_E1 = f"SELECT *, {_cat(1, chr(39) + 'S' + chr(39) + f' || list_position({_SEVERITIES}, severity)')} AS s0, {_cat(0, repr(''))} AS operator, {_cat(3, repr('mask'))} AS a0, {_cat(4, repr('<PII>'))} AS replacement FROM ({_E0})"
_E2 = f"SELECT *, {_cat(2, chr(39) + 'T' + chr(39) + ' || (substr(s0, 2)::INT - 1)')} AS t0, entity IN {policies.HIGHEST} AS top, minor AND entity IN {policies.RAISED} AS raised FROM ({_E1})"
_E3 = f"SELECT *, CASE WHEN top THEN 'S4' WHEN raised THEN greatest(s0, 'S3') ELSE s0 END AS sens, CASE WHEN top THEN 'T3' WHEN raised THEN greatest(t0, 'T2') ELSE t0 END AS train FROM ({_E2})"


@query(f"SELECT doc_id, ord, entity, operator, sens AS sensitivity, train AS training, a0 AS action, replacement FROM ({_E3})")
def privacy_catalog_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.privacy_rule_hits(privacy_findings(spark, sf_dir)).select("doc_id", "ord", "entity", "operator", "sensitivity", "training", "action", "replacement")


_PP = "(VALUES " + ", ".join("(" + ", ".join(_sql(x) for x in (*r, k)) + ")" for k, r in enumerate(policies.PRIVACY_POLICIES)) + ") p(policy_id, priority, entities, subjects, purposes, p_sensitivity, p_training, p_annotation, p_action, p_route, p_allow, p_review, nth)"
_PTOP = f"""SELECT * FROM (SELECT f.*, p.*, row_number() OVER (PARTITION BY doc_id, ord ORDER BY priority DESC NULLS LAST, nth) AS r FROM ({_E3}) f LEFT JOIN {_PP} ON list_contains(entities, entity)
  AND (len(subjects) = 0 OR list_contains(subjects, CASE WHEN subject_type = '' THEN 'unknown' ELSE subject_type END)) AND (len(purposes) = 0 OR list_contains(purposes, purpose))) WHERE r = 1"""
_route = lambda a: "CASE " + a + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in policies.ROUTE.items()) + " END"
_ann = lambda a: "CASE " + a + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in policies.ANNOTATION.items()) + " END"
_P1 = f"""SELECT doc_id, ord, entity, policy_id, purpose, coalesce(p_sensitivity, sens) AS sensitivity, coalesce(p_training, train) AS training, coalesce(p_annotation, {_ann('a0')}) AS annotation, coalesce(p_action, a0) AS action,
  coalesce(p_route, {_route('a0')}) AS route, coalesce(p_allow, true) AS allow, coalesce(p_review, need) AS review, CASE entity {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _ENTITY.items())} END AS own FROM ({_PTOP})"""
_by = lambda i: "CASE own " + " ".join(f"WHEN '{k}' THEN {_sql(v[i])}" for k, v in policies.BY_ACTION.items()) + " END"
_P2 = f"""SELECT * REPLACE (greatest(sensitivity, coalesce({_by(0)}, 'S0')) AS sensitivity, greatest(training, coalesce({_by(1)}, 'T0')) AS training, CASE WHEN w THEN own ELSE action END AS action, CASE WHEN w THEN {_route('own')} ELSE route END AS route,
  CASE WHEN w THEN {_ann('own')} ELSE annotation END AS annotation, allow AND coalesce({_by(2)}, true) AS allow, review OR coalesce({_by(3)}, false) AS review)
FROM (SELECT *, coalesce(list_position({policies.ACTIONS}, own) > list_position({policies.ACTIONS}, action), false) AS w FROM ({_P1}))"""
_PD = f"SELECT doc_id, ord, entity, policy_id, sensitivity, training, annotation, action, route, allow AND NOT (purpose = 'training' AND training IN ('T2', 'T3')) AS allow, review, action IN ('mask', 'generalize', 'restricted_review') AS redact FROM ({_P2})"


def _privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.privacy_decisions(privacy_findings(spark, sf_dir), policies.rule_table(spark, policies.PRIVACY_POLICIES, policies.PRIVACY_KIND), _ENTITY)


@query(_PD)
def privacy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _privacy(spark, sf_dir)


@query(f"""SELECT d.doc_id, coalesce(max(sensitivity), 'S1') AS sensitivity, coalesce(max(training), 'T0') AS training, {policies.ACTIONS}[coalesce(max(list_position({policies.ACTIONS}, action)), 1)] AS action,
  {_route(f"{policies.ACTIONS}[coalesce(max(list_position({policies.ACTIONS}, action)), 1)]")} AS route, coalesce(bool_and(allow), true) AS allow, coalesce(bool_or(review), false) AS review, count(ord) AS findings FROM documents d LEFT JOIN ({_PD}) c USING (doc_id) GROUP BY d.doc_id""")
def privacy_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.privacy_governance(table(spark, sf_dir, "documents"), _privacy(spark, sf_dir))
