"""Governance policies: rule tables, their theta joins with findings, and the decisions for content and personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.ranks import CONTENT_RISK, DISPOSITION, SENSITIVITY, SEVERITY, TRAINING, code, lookup, rank

_OUT, _EVAL, _REST = ("C3", "P4", "T3", "exclude_from_training", False, False), ("C2", "P3", "T2", "safety_review_or_eval_only", False, True), ("C1", "P2", "T1", "restricted_training_after_review", True, False)
_CONTEXTS = ["education", "research", "news", "legal_case", "literary_or_fictional", "quotation", "safety_education", "public_interest"]
# Content policies (id, labels, least severity, contexts, audience, priority, then risk, action, training, route, allow, review).
CONTENT_POLICIES = [
    ("content_minor_harmful_sexualization_zero_tolerance", ["content.minor_harmful.sexualization"], "low", [], "", 130, *_OUT),
    ("content_minor_harmful_zero_tolerance", ["content.minor_harmful"], "low", [], "", 120, *_OUT),
    ("content_minor_harmful_imitation_exclude", ["content.minor_harmful.imitation"], "medium", [], "", 118, *_OUT),
    ("content_self_harm_encouragement_exclude", ["content.self_harm"], "medium", [], "", 110, *_OUT),
    ("content_safety_minor_audience_strict", [], "medium", [], "minor", 105, *_OUT),
    ("content_violent_actionable_exclude", ["content.violent", "content.violent.encouragement", "content.illegal_instruction", "content.illegal_instruction.step_by_step"], "high", [], "", 96, *_OUT),
    ("content_violent_graphic_review", ["content.violent.graphic_description"], "medium", [], "", 85, *_EVAL),
    ("content_pornographic_high_risk_exclude", ["content.pornographic"], "high", [], "", 94, *_OUT),
    ("content_hate_high_risk_exclude", ["content.hate"], "high", [], "", 94, *_OUT),
    ("content_jailbreak_training_exclude", ["content.jailbreak"], "high", [], "", 94, *_OUT),
    ("content_jailbreak_prompt_injection_exclude", ["content.jailbreak.prompt_injection"], "medium", [], "", 93, *_OUT),
    ("content_safety_high_risk_exclude", ["content.violent", "content.pornographic", "content.hate", "content.illegal_instruction", "content.jailbreak"], "high", [], "", 90, *_OUT),
    ("content_safety_contextual_review", [], "low", _CONTEXTS, "", 70, *_EVAL),
    ("content_safety_medium_review", [], "medium", [], "", 50, *_EVAL),
    ("content_safety_low_restricted_review", [], "low", [], "", 10, *_REST),
]
CONTENT_KIND = "policy_id string, labels array<string>, least string, contexts array<string>, audience string, priority int, p_risk string, p_action string, p_training string, p_route string, p_allow boolean, p_review boolean"

_FORBID = ("S4", "T3", "training_forbidden", "drop_or_manual_review", "exclude_from_training", False, True)
# Privacy policies (id, priority, entities, subjects, purposes, then sensitivity, training, annotation, action, route, allow, review).
PRIVACY_POLICIES = [
    ("privacy.secret.credentials.forbid_training.v1", 100, ["secret", "api_key", "token", "password", "credential"], [], [], *_FORBID),
    ("privacy.strong_identifier.forbid_plaintext_training.v1", 95, ["id_card", "passport", "bank_card", "bank_account", "payment_account"], [], [], *_FORBID),
    ("privacy.student.education_record.restricted.v1", 90, ["education_record", "student_id"], ["student", "minor", "unknown"], [], "S3", "T2", "restricted_only", "restricted_review", "restricted_privacy_review_pool", False, True),
    ("privacy.guardian.contact.mask.v1", 88, ["parent_contact", "guardian_contact"], [], [], "S3", "T2", "allow_after_redaction", "mask", "restricted_training_after_redaction", True, False),
    ("privacy.contact.training.mask.v1", 70, ["phone_number", "phone", "email", "social_account"], [], ["training", "annotation", "general_training", "model_training"], "S2", "T1", "allow_after_redaction", "mask", "training_after_redaction", True, False),
    ("privacy.address.generalize.v1", 65, ["address", "location"], [], [], "S3", "T1", "allow_after_redaction", "generalize", "training_after_generalization", True, False),
    ("privacy.combined.identity.restricted.v1", 85, ["combined_identity"], [], [], "S4", "T3", "restricted_only", "restricted_review", "restricted_privacy_review_pool", False, True),
    ("privacy.medical.psychology.forbid_training.v1", 93, ["medical_record", "psychological_record", "health_record"], [], [], *_FORBID),
]
PRIVACY_KIND = "policy_id string, priority int, entities array<string>, subjects array<string>, purposes array<string>, p_sensitivity string, p_training string, p_annotation string, p_action string, p_route string, p_allow boolean, p_review boolean"

# Entity -> (operator, sensitivity, training, action, replacement, aliases).
CATALOG = {
    "person_name": ("PII_001", "S2", "T1", "mask", "<PERSON>", ["name", "student_name", "parent_name", "teacher_name"]),
    "phone_number": ("PII_002", "S3", "T1", "mask", "<PHONE>", ["phone", "mobile", "contact"]),
    "email": ("PII_002", "S2", "T1", "mask", "<EMAIL>", ["mail", "email_address"]),
    "social_account": ("PII_002", "S2", "T1", "mask", "<SOCIAL_ACCOUNT>", ["wechat_id", "qq_number", "social_id"]),
    "id_card": ("PII_003", "S4", "T3", "drop_or_manual_review", "<ID_CARD>", ["id_number", "passport", "credential_id"]),
    "address": ("PII_004", "S3", "T2", "generalize", "<ADDRESS>", ["home_address", "location"]),
    "student_id": ("PII_005", "S3", "T2", "mask", "<STUDENT_ID>", ["student_number", "exam_number"]),
    "education_record": ("PII_005", "S3", "T2", "restricted_review", "<EDU_RECORD>", ["score_record", "disciplinary_record", "growth_record"]),
    "parent_contact": ("PII_006", "S3", "T2", "mask", "<PARENT_CONTACT>", ["guardian_contact", "family_contact"]),
    "bank_card": ("PII_007", "S4", "T3", "drop_or_manual_review", "<BANK_CARD>", ["bank_account", "payment_account"]),
    "payment_account": ("PII_007", "S4", "T3", "drop_or_manual_review", "<PAYMENT_ACCOUNT>", ["alipay_id", "payment_id"]),
    "medical_record": ("PII_008", "S4", "T3", "drop_or_manual_review", "<MEDICAL_RECORD>", ["health_record", "psychological_record", "psychology_record"]),
    "secret": ("PII_009", "S4", "T3", "drop_or_manual_review", "<SECRET>", ["api_key", "token", "password", "credential"]),
    "combined_identity": ("PII_010", "S4", "T3", "restricted_review", "<COMBINED_IDENTITY>", ["combined_pii", "profile_identity"]),
    "minor_info": ("PII_011", "S4", "T3", "restricted_review", "<MINOR_INFO>", ["student_minor", "child_info"]),
}
# Types that a minor's context raises, and types that are always of the highest level.
RAISED = ("person_name", "phone_number", "email", "address", "student_id", "education_record", "parent_contact")
HIGHEST = ("id_card", "bank_card", "medical_record", "secret", "combined_identity")
# What an action of either engine means.
ACTIONS = ["retain", "mask", "generalize", "restricted_review", "drop_or_manual_review"]
ROUTE = {"retain": "general_training", "mask": "training_after_redaction", "generalize": "training_after_generalization", "restricted_review": "restricted_privacy_review_pool", "drop_or_manual_review": "exclude_from_training"}
ANNOTATION = {"retain": "allow_raw", "mask": "allow_after_redaction", "generalize": "allow_after_redaction", "restricted_review": "restricted_only", "drop_or_manual_review": "training_forbidden"}
BY_ACTION = {"retain": ("S1", "T0", True, False), "mask": ("S2", "T1", True, False), "generalize": ("S3", "T1", True, False), "restricted_review": ("S3", "T2", False, True), "drop_or_manual_review": ("S4", "T3", False, True)}
GOVERNED = {"P0": ("C0", "T0", "general_training", True, False), "P1": ("C1", "T0", "general_training", True, False), "P2": ("C1", *_REST[2:]), "P3": ("C2", *_EVAL[2:]), "P4": ("C3", *_OUT[2:]), "P5": ("C3", *_OUT[2:])}
YOUNG = ("minor", "minors", "student", "students", "child", "children")
TRAINING_USES = ("training", "training_candidate", "model_training", "general_training", "pretraining")


def rule_table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A small rule table with the order of its rows (nth); joins broadcast it, as its size is that of the rule file."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{kind}, nth int")


def extends(labels: Column, wanted: Column) -> Column:
    """Whether a label equals a wanted one or is a dotted child of it."""
    return F.exists(labels, lambda a: F.exists(wanted, lambda b: (a != "") & (b != "") & ((a == b) | a.startswith(F.concat(b, F.lit("."))))))


def related(labels: Column, wanted: Column) -> Column:
    """Whether a label equals, extends or is extended by a wanted one."""
    return extends(labels, wanted) | extends(wanted, labels)


def content_policy_hits(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings with every policy that applies.

    findings: doc_id, ord, policy_tag, risk_type, severity, context_type, audience. Labels match from the policy down;
    the audience is compared as it stands, all else in small letters.
    """
    p = F.broadcast(policies)
    labels = F.array(F.lower("policy_tag"), F.lower("risk_type"))
    match = ((F.size("labels") == 0) | extends(labels, F.col("labels"))) & (rank(F.col("severity"), SEVERITY) >= rank(F.col("least"), SEVERITY))
    match = match & ((F.size("contexts") == 0) | F.array_contains("contexts", F.lower("context_type"))) & ((F.col("p.audience") == "") | (F.col("p.audience") == F.col("f.audience")))
    return findings.alias("f").join(p.alias("p"), match, "left").select("f.*", *[F.col(f"p.{c}") for c in policies.columns if c != "audience"])


def first_hit(hits: DataFrame) -> DataFrame:
    """Each finding with its policy of highest priority, the first of equals; or with none."""
    w = Window.partitionBy("doc_id", "ord").orderBy(F.col("priority").desc_nulls_last(), "nth")
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "nth", "labels", "least", "contexts", "entities", "subjects", "purposes")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """doc_id, policies: the policies of a document's findings, each once, highest priority first."""
    one = hits.filter("policy_id is not null").groupBy("doc_id", "policy_id").agg(F.max("priority").alias("p"), F.min("nth").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "n", "policy_id")))
    return one.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["policy_id"]), ",").alias("policies"))


def stricter(now: dict[str, Column], other: dict[str, Column], orders: dict[str, list[str]], on: Column) -> dict[str, Column]:
    """A decision with the stricter of each code; the other's route goes with its action; a refusal and a review stay."""
    out = {k: F.when(on & (rank(other[k], o) > rank(now[k], o)), other[k]).otherwise(now[k]) for k, o in orders.items()}
    wins = on & (rank(other["action"], orders["action"]) >= rank(out["action"], orders["action"]))
    out["route"] = F.when(wins & (other["route"] != ""), other["route"]).otherwise(now["route"])
    out["allow"] = now["allow"] & ~(on & ~other["allow"])
    out["review"] = now["review"] | (on & other["review"])
    return out


CONTENT_ORDERS = {"risk": CONTENT_RISK, "action": DISPOSITION, "training": TRAINING}


def governed(action: Column) -> dict[str, Column]:
    """Risk, action, training, route, allow and review that a disposition means."""
    names = ("risk", "training", "route", "allow", "review")
    return {"action": action} | {n: lookup(action, {k: v[i] for k, v in GOVERNED.items()}) for i, n in enumerate(names)}


# Words by which a policy in plain text asks for exclusion, words that name everything, and scopes that it may name.
STRICT_WORDS = ("exclude", "block", "ban", "reject", "禁止", "阻止", "剔除", "排除")
ALL_WORDS = ("all", "全部")
INJECTION = ("jailbreak", "prompt injection", "prompt-injection")
SCOPES = ("violence", "violent", "hate", "porn", "self_harm")


def text_policy(said: str, about: Column) -> Column:
    """The condition that a policy in plain text compiles to, on what is said about a finding (tag, type, explanation): whether it is to be excluded."""
    text, low = said.strip().lower(), F.lower(about)
    if not any(w in text for w in STRICT_WORDS):
        return F.lit(False)
    if any(w in text for w in ALL_WORDS):
        return F.lit(True)
    out = F.lit(False)
    if any(w in text for w in INJECTION):
        out = F.contains(low, F.lit("jailbreak")) | F.contains(low, F.lit("prompt"))
    for w in SCOPES:
        if w in text:
            out = out | F.contains(low, F.lit(w))
    return out


def content_decisions(findings: DataFrame, policies: DataFrame, custom: dict[str, str] | None = None, policy_text: str = "") -> DataFrame:
    """doc_id, ord, policy_id, risk, action, training, route, allow, review of every content finding.

    findings as for :func:`content_policy_hits`, with needs_adjudication, downstream_use, and of a semantic adjudicator
    sem_decision ('' for none), sem_upgrade, sem_downgrade, sem_risk, sem_action, sem_training, sem_route. In order: what severity
    says, the first policy, the adjudicator (up as far as it says, down to review at most, and never for minors), a young
    audience, a policy in plain text (``policy_text``), the custom actions (label -> disposition; labels match both ways), the use in training.
    """
    out = first_hit(content_policy_hits(findings, policies))
    sev, need, met = F.col("severity"), F.col("needs_adjudication"), F.col("policy_id").isNotNull()
    base = governed(F.when(sev.isin("critical", "high"), "P4").when(need | (sev == "medium"), "P3").otherwise("P2"))
    names = ("risk", "action", "training", "route", "allow", "review")
    out = out.withColumns({n: F.when(met, F.col(f"p_{n}")).otherwise(base[n]) for n in names})
    now = {n: F.col(n) for n in names}

    young = F.lower("audience").isin(*YOUNG)
    strict = F.lower(F.concat_ws(" ", "policy_tag", "risk_type")).rlike("minor_harmful|self_harm|sexual exploitation|child")
    said = F.col("sem_decision") != ""
    up = stricter(now, {"risk": F.col("sem_risk"), "action": F.col("sem_action"), "training": F.col("sem_training"), "route": F.col("sem_route"), "allow": F.lit(True), "review": F.lit(False)}, CONTENT_ORDERS, said & F.col("sem_upgrade"))
    down = said & ~F.col("sem_upgrade") & F.col("sem_downgrade") & ~young & ~strict
    review = {"risk": F.when(F.col("sem_risk").isin("", "C0", "C1", "C2"), "C2").otherwise(F.col("sem_risk")), "action": F.lit("P3"), "training": F.lit("T2"), "route": F.when(F.col("sem_route") != "", F.col("sem_route")).otherwise("safety_review_or_eval_only"), "allow": F.lit(False), "review": F.lit(True)}
    out = out.withColumns({n: F.when(down, review[n]).otherwise(up[n]) for n in names})

    block = governed(F.lit("P4"))
    out = out.withColumns({n: F.when(young & sev.isin("high", "critical"), block[n]).otherwise(now[n]) for n in names})

    if policy_text.strip():
        about = F.concat_ws(" ", *[F.col(c) for c in ("policy_tag", "risk_type", "explanation", "matched_label") if c in out.columns])
        on = F.coalesce(text_policy(policy_text, about), F.lit(False))
        out = out.withColumns(stricter(now, block, CONTENT_ORDERS, on))
    if custom:
        labels = F.array(F.lower("policy_tag"), F.lower("risk_type"))
        picks = [F.when(related(labels, F.array(F.lit(k.lower()))), F.lit(DISPOSITION.index(v))) for k, v in custom.items() if v in DISPOSITION]
        none = F.lit(None).cast("int")
        best = F.greatest(none, none, *picks)
        out = out.withColumn("_own", F.when(best.isNotNull(), code(best, DISPOSITION)))
        out = out.withColumns(stricter(now, governed(F.col("_own")), CONTENT_ORDERS, F.col("_own").isNotNull())).drop("_own")
    blocked = F.lower("downstream_use").isin("training_candidate", "model_training", "pretraining") & F.col("action").isin("P3", "P4")
    return out.withColumn("allow", F.col("allow") & ~blocked).select("doc_id", "ord", "policy_id", *names)


def entity_of(risk: Column) -> Column:
    """Catalogue entity of a risk type: itself, else the first that has it for an alias."""
    alias: dict[str, str] = {}
    for name, v in CATALOG.items():
        for a in v[5]:
            alias.setdefault(a, name)
    return F.when(risk.isin(*CATALOG), risk).otherwise(F.coalesce(lookup(risk, {a: n for a, n in alias.items() if a not in CATALOG}), risk))


def privacy_rule_hits(findings: DataFrame) -> DataFrame:
    """findings (doc_id, ord, risk_type, severity, minor) with entity, operator, sensitivity, training, action, replacement by catalogue and floors."""
    out = findings.withColumn("entity", entity_of(F.col("risk_type")))
    e = F.col("entity")
    of = lambda k: lookup(e, {n: v[k] for n, v in CATALOG.items()})
    sens = F.coalesce(of(1), lookup(F.col("severity"), {"low": "S1", "medium": "S2", "high": "S3", "critical": "S4"}, "S2"))
    train = F.coalesce(of(2), lookup(sens, {"S1": "T0", "S2": "T1", "S3": "T2", "S4": "T3"}, "T1"))
    raised = F.col("minor") & e.isin(*RAISED)
    top = e.isin(*HIGHEST)
    return out.withColumns({
        "operator": F.coalesce(of(0), F.lit("")),
        "sensitivity": F.when(top, "S4").when(raised & (rank(sens, SENSITIVITY) < 2), "S3").otherwise(sens),
        "training": F.when(top, "T3").when(raised & (rank(train, TRAINING) < 2), "T2").otherwise(train),
        "action": F.coalesce(of(3), F.lit("mask")), "replacement": F.coalesce(of(4), F.lit("<PII>")),
    })


def privacy_policy_hits(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings with every privacy policy for their entity, subject (unknown where none is given) and purpose."""
    p = F.broadcast(policies)
    subject = F.lower(F.when(F.col("subject_type") != "", F.col("subject_type")).otherwise("unknown"))
    match = F.array_contains("entities", F.col("entity")) & ((F.size("subjects") == 0) | F.array_contains("subjects", subject)) & ((F.size("purposes") == 0) | F.array_contains("purposes", F.lower("purpose")))
    return findings.join(p, match, "left")


def privacy_decisions(findings: DataFrame, policies: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """doc_id, ord, entity, policy_id, sensitivity, training, annotation, action, route, allow, review, redact of every privacy finding.

    findings: doc_id, ord, risk_type, severity, minor, needs_adjudication, subject_type, purpose. In order: catalogue and
    floors, the first policy, the custom actions of entities where they are stricter, the use in training.
    """
    out = first_hit(privacy_policy_hits(privacy_rule_hits(findings), policies))
    met = F.col("policy_id").isNotNull()
    by = {"sensitivity": F.col("sensitivity"), "training": F.col("training"), "annotation": lookup(F.col("action"), ANNOTATION), "action": F.col("action"), "route": lookup(F.col("action"), ROUTE), "allow": F.lit(True), "review": F.col("needs_adjudication")}
    out = out.select("*", *[F.when(met, F.col(f"p_{n}")).otherwise(c).alias(f"d_{n}") for n, c in by.items()])
    now = {n: F.col(f"d_{n}") for n in by}
    if custom:
        own = lookup(F.col("entity"), custom)
        out = out.withColumn("_own", own)
        name, on = F.col("_own"), F.col("_own").isNotNull()
        parts = dict(zip(("sensitivity", "training", "allow", "review"), range(4)))
        other = {n: lookup(name, {a: v[k] for a, v in BY_ACTION.items()}) for n, k in parts.items()} | {"action": name, "route": lookup(name, ROUTE)}
        wins = on & (rank(name, ACTIONS) > rank(now["action"], ACTIONS))
        new = {n: F.when(on & (rank(other[n], o) > rank(now[n], o)), other[n]).otherwise(now[n]) for n, o in (("sensitivity", SENSITIVITY), ("training", TRAINING))}
        new |= {"action": F.when(wins, name).otherwise(now["action"]), "route": F.when(wins, other["route"]).otherwise(now["route"]), "annotation": F.when(wins, lookup(name, ANNOTATION)).otherwise(now["annotation"])}
        new |= {"allow": now["allow"] & ~(on & ~F.coalesce(other["allow"], F.lit(True))), "review": now["review"] | (on & F.coalesce(other["review"], F.lit(False)))}
        out = out.withColumns({f"d_{n}": c for n, c in new.items()})
    blocked = F.lower("purpose").isin(*TRAINING_USES) & now["training"].isin("T2", "T3")
    return out.select(
        "doc_id", "ord", "entity", "policy_id", *[now[n].alias(n) for n in ("sensitivity", "training", "annotation", "action", "route")],
        (now["allow"] & ~blocked).alias("allow"), now["review"].alias("review"), now["action"].isin("mask", "generalize", "restricted_review").alias("redact"),
    )


def privacy_governance(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, sensitivity, training, action, route, allow, review, findings of every document: the highest codes of its findings."""
    a = decisions.groupBy("doc_id").agg(
        F.max("sensitivity").alias("s"), F.max("training").alias("t"), F.max(rank(F.col("action"), ACTIONS)).alias("a"), F.bool_and("allow").alias("y"), F.bool_or("review").alias("v"), F.count("*").alias("n")
    )
    out = docs.select("doc_id").join(a, "doc_id", "left").withColumn("action", code(F.coalesce("a", F.lit(0)), ACTIONS))
    return out.select("doc_id", F.coalesce("s", F.lit("S1")).alias("sensitivity"), F.coalesce("t", F.lit("T0")).alias("training"), "action", lookup(F.col("action"), ROUTE).alias("route"), F.coalesce("y", F.lit(True)).alias("allow"), F.coalesce("v", F.lit(False)).alias("review"), F.coalesce("n", F.lit(0)).cast("bigint").alias("findings"))


def content_governance(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, risk, action, training, route (the last finding's), allow, review, findings of every document."""
    a = decisions.groupBy("doc_id").agg(F.max("risk").alias("r"), F.max("action").alias("a"), F.max("training").alias("t"), F.max_by("route", "ord").alias("o"), F.bool_and("allow").alias("y"), F.bool_or("review").alias("v"), F.count("*").alias("n"))
    out = docs.select("doc_id").join(a, "doc_id", "left")
    return out.select("doc_id", F.coalesce("r", F.lit("C0")).alias("risk"), F.coalesce("a", F.lit("P0")).alias("action"), F.coalesce("t", F.lit("T0")).alias("training"), F.coalesce("o", F.lit("general_training")).alias("route"), F.coalesce("y", F.lit(True)).alias("allow"), F.coalesce("v", F.lit(False)).alias("review"), F.coalesce("n", F.lit(0)).cast("bigint").alias("findings"))


def policies_from(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Policies of a JSON-lines file in the columns of :data:`CONTENT_KIND` or :data:`PRIVACY_KIND`; those marked ``enabled: false`` are left out, a missing file gives none."""
    kind = CONTENT_KIND if content else PRIVACY_KIND
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return rule_table(spark, [], kind)
    got = spark.read.schema(f"enabled boolean, {kind}").json(path).filter(F.coalesce("enabled", F.lit(True))).drop("enabled")
    return got.withColumn("nth", F.monotonically_increasing_id().cast("int"))
