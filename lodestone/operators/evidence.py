"""Evidence of several detectors put together: joins by reference, best of repeated findings, manifests, rule cascades, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.ranks import DISPOSITION, SEVERITY, code, lookup, rank
from lodestone.tables import merged

#: documents and hits of a block of a source
DOC_BLOCK, HIT_BLOCK = 1 << 13, 256


def with_first(rows: DataFrame, other: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left join with the first row of ``other`` for each key; further ones are not seen."""
    first = other.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_x"))
    return rows.join(first, key, "left").select(rows.columns + [F.col(f"_x.{c}").alias(c) for c in columns])


def target_events(targets: DataFrame, events: DataFrame) -> DataFrame:
    """targets (finding_id, event_id) with the first event (event_id, ord, finding_refs array; of equals that of the smallest id) that refers to their finding, else their own."""
    refs = events.select("event_id", "ord", F.explode("finding_refs").alias("finding_id"))
    first = refs.groupBy("finding_id").agg(F.min_by("event_id", F.struct("ord", "event_id")).alias("_e"))
    return targets.join(first, "finding_id", "left").withColumn("event_id", F.coalesce("_e", "event_id")).drop("_e")


def located_secrets(secrets: DataFrame, sources: DataFrame) -> DataFrame:
    """secrets (path, scan_source) with the source of their path, else the source that was being scanned."""
    by = sources.groupBy("path").agg(F.min("source_id").alias("_s"))
    return secrets.join(by, "path", "left").withColumn("source_id", F.coalesce("_s", "scan_source")).drop("_s")


def of_own_source(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits of a source with its documents: a hit counts for the documents of its own source alone.

    Rows grow with documents times hits, so within a source both are dealt into blocks, of which every two are one key of
    the join: no source has to fit a task, and what moves is each row once for every block of the other side. A document
    stands beside the same few hits as its neighbours, which files store in little room.
    """
    size = lambda rows, most, name: rows.groupBy("source_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = size(docs, DOC_BLOCK, "_docs").join(size(hits, HIT_BLOCK, "_hits"), "source_id")
    dealt = lambda rows, own, other, part, each: rows.join(blocks, "source_id").withColumn(part, F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int")).withColumn(each, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_docs", "_hits")
    d, h = dealt(docs.select("doc_id", "source_id"), "_docs", "_hits", "_d", "_h"), dealt(hits, "_hits", "_docs", "_h", "_d")
    key, spread = ["source_id", "_d", "_h"], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of few bytes many rows come
    return d.repartition(spread, *key).join(h.repartition(spread, *key), key).drop("_d", "_h")


def planned_or_unlocated(findings: DataFrame, plan: DataFrame, key: str = "finding_id", span: str = "start") -> DataFrame:
    """Findings that a redaction plan holds, and those without a span; where a document has no plan at all, all of them."""
    held = plan.select(key).distinct().withColumn("_in", F.lit(True))
    planned = plan.select("doc_id").distinct().withColumn("_any", F.lit(True))
    out = findings.join(held, key, "left").join(planned, "doc_id", "left")
    return out.filter(F.col(span).isNull() | F.col("_in") | F.col("_any").isNull()).drop("_in", "_any")


def best_of(findings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of findings equal in ``keys`` the most confident one, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), order)
    return findings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def provider_manifest(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """run, providers (key=provider@version, the last of a key, in order of key), timeline (step=ms of steps that took time; the last of a step)."""
    name = F.when(F.col("version") != "", F.concat("provider", F.lit("@"), "version")).otherwise(F.col("provider"))
    last = steps.groupBy(run, "step").agg(F.max_by(name, F.when(F.col("provider") != "", F.col("ord"))).alias("p"), F.max_by("ms", F.when(F.col("ms") > 0, F.col("ord"))).alias("t"))
    pair = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.concat("step", F.lit("="), F.col(c).cast("string"))))), ",")
    return last.groupBy(run).agg(pair("p").alias("providers"), pair("t").alias("timeline"))


def rule_scores(docs: DataFrame) -> DataFrame:
    """doc_id, five scores, decision and reasons from secrets, safety_level, pii, compliance, keywords, regexes; the first rule that applies decides."""
    pii, hits, level = F.col("pii"), F.col("keywords") + F.col("regexes"), F.col("safety_level")
    out = docs.select(
        "*", F.when(F.col("secrets") > 0, 0.0).otherwise(1.0).alias("s_secrets"), F.when(level == "unsafe", 0.0).when(level == "controversial", 0.5).otherwise(1.0).alias("s_safety"),
        F.when(pii > 5, 0.3).when(pii > 0, 0.7).otherwise(1.0).alias("s_privacy"), F.when(F.col("compliance") > 0, 0.2).otherwise(1.0).alias("s_compliance"), F.when(hits > 20, 0.2).when(hits > 5, 0.6).otherwise(1.0).alias("s_text"),
    )
    s = {n: F.col(f"s_{n}") for n in ("secrets", "safety", "privacy", "compliance", "text")}
    choice = F.when((s["secrets"] == 0) | (s["safety"] == 0), "reject").when((s["compliance"] <= 0.3) | (s["privacy"] <= 0.3), "quarantine").when((s["text"] <= 0.6) | (s["safety"] <= 0.5), "review").otherwise("allow")
    said = F.array_compact(F.array(
        F.when(F.col("secrets") > 0, F.format_string("found %d leaked secret(s)", F.col("secrets"))), F.when(level != "safe", F.concat(F.lit("content classified as "), F.upper(level))),
        F.when(pii > 5, F.format_string("high PII density: %d entities", pii)), F.when(F.col("compliance") > 0, F.format_string("%d license compliance issue(s)", F.col("compliance"))),
    ))
    return out.select("doc_id", *s.values(), choice.alias("decision"), F.array_join(said, "; ").alias("reasons"))


def overall(decisions: DataFrame, by: list[str]) -> DataFrame:
    """The gravest decision of each group; reject, quarantine, review, allow."""
    order = ["allow", "review", "quarantine", "reject"]
    return decisions.groupBy(*by).agg(code(F.max(rank(F.col("decision"), order)), order).alias("overall"))


def conclusions(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, risk_level (highest severity, none without findings) and conclusion (passed, review, failed) of every document."""
    top = findings.groupBy("doc_id").agg(F.max(rank(F.col("severity"), SEVERITY)).alias("_t"))
    out = docs.select("doc_id").join(top, "doc_id", "left").withColumn("risk_level", F.when(F.col("_t").isNull(), "none").otherwise(code(F.col("_t"), SEVERITY)))
    return out.select("doc_id", "risk_level", F.when(F.col("_t").isNull(), "passed").when(F.col("risk_level").isin("high", "critical"), "failed").otherwise("review").alias("conclusion"))


def percentile_level(histogram: DataFrame, by: str, share: float) -> DataFrame:
    """by, level: the first level at which a histogram (level, n) has reached the share of its total; 255 for an empty one."""
    w = Window.partitionBy(by)
    reached = F.sum("n").over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) >= F.sum("n").over(w) * share
    h = histogram.withColumn("_r", reached & (F.sum("n").over(w) > 0))
    return h.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("_r"), F.col("level"))), F.lit(255)).cast("int").alias("level"))


# Dispositions that actions of fragments and assessments ask for.
PRIVACY_FLOOR = {"redact": 1, "generalize": 2, "manual_review": 3, "exclude_from_training": 3}
CONTENT_FLOOR = {"restricted_review": 2, "manual_review": 3, "exclude_from_training": 4, "reject": 4}
PRIVACY_ASSESSED = {"keep": 0, "redact": 1, "generalize": 2, "manual_review": 3, "exclude_from_training": 3}
CONTENT_ASSESSED = {"keep": 0, "restricted_review": 2, "manual_review": 3, "exclude_from_training": 4, "reject": 4}


def fragment_floor(chain: Column, action: Column) -> Column:
    """Least disposition rank that a fragment's action asks for."""
    return F.when(chain == "privacy", lookup(action, PRIVACY_FLOOR, 0)).otherwise(lookup(action, CONTENT_FLOOR, 0))


def localised_floor(degraded: Column, severity: Column, adjudicated: Column) -> Column:
    """Of a localised fragment: where adjudication covered the document only a degraded one counts."""
    return F.when(degraded, 3).when(adjudicated, 0).otherwise(lookup(severity, {"critical": 3, "high": 3, "medium": 2, "low": 1}, 1))


def assessment_floor(chain: Column, action: Column, may_raise: Column) -> Column:
    """Of a document's assessment; one that may not raise asks for nothing."""
    return F.when(~may_raise, 0).when(chain == "privacy", lookup(action, PRIVACY_ASSESSED, 1)).otherwise(lookup(action, CONTENT_ASSESSED, 3))


def document_floor(docs: DataFrame, fragments: DataFrame, localised: DataFrame, assessments: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, disposition: the highest of all floors. fragments: doc_id, chain, action; localised: doc_id, degraded, severity; assessments: doc_id, chain, action, may_raise; events: doc_id, chain, floor.

    An assessment that may raise takes the place of the events of its own chain.
    """
    adjudicated = fragments.filter("chain = 'content'").select("doc_id").distinct().withColumn("_adj", F.lit(True))
    loc = merged(localised, adjudicated, "doc_id", "left").select("doc_id", localised_floor(F.col("degraded"), F.col("severity"), F.coalesce("_adj", F.lit(False))).alias("f"))
    judged = assessments.filter("may_raise").select("doc_id", "chain").distinct()
    left = merged(events, judged, ["doc_id", "chain"], "left_anti").select("doc_id", F.col("floor").alias("f"))
    every = fragments.select("doc_id", fragment_floor(F.col("chain"), F.col("action")).alias("f")).unionByName(loc).unionByName(left)
    every = every.unionByName(assessments.select("doc_id", assessment_floor(F.col("chain"), F.col("action"), F.col("may_raise")).alias("f")))
    top = every.groupBy("doc_id").agg(F.max("f").alias("f"))
    return merged(docs.select("doc_id"), top, "doc_id", "left").select("doc_id", code(F.coalesce("f", F.lit(0)).cast("int"), DISPOSITION).alias("disposition"))


# What is done at each disposition.
DONE = {
    "P0": ("release", "none", ""), "P1": ("apply_redaction,release", "structured_masking", ""), "P2": ("apply_redaction,restrict_internal_access,hold_external_delivery", "structured_masking", ""),
    "P3": ("manual_review_required,hold_delivery", "manual_redaction_plan", "hard_case_or_boundary_risk"), "P4": ("block_delivery,escalate_compliance", "block", "high_risk_content_or_sensitive_data"),
    "P5": ("block_delivery,traceback_and_incident_response", "block_and_traceback", "circulated_high_risk_data"),
}


def actions_of(disposition: Column) -> list[Column]:
    """actions, redaction strategy and escalation reason of a disposition."""
    return [lookup(disposition, {k: v[i] for k, v in DONE.items()}).alias(n) for i, n in enumerate(("actions", "strategy", "escalation"))]


def privacy_final(decisions: DataFrame, tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, action, training, review_status, review_tasks, reviewed, source of every decision after its reviews, which apply in the order of tasks.

    tasks: doc_id, finding_id, ord; reviews: finding_id, submitted, action, training ('' keeps what was); the last review of a finding counts.
    """
    last = reviews.groupBy("finding_id").agg(F.max_by(F.struct("action", "training"), "submitted").alias("r"))
    t = tasks.join(last, "finding_id", "left")
    given = lambda n: F.max_by(F.col(f"r.{n}"), F.when(F.col(f"r.{n}") != "", F.col("ord")))
    a = t.groupBy("doc_id").agg(F.count("*").alias("review_tasks"), F.count("r").alias("reviewed"), given("action").alias("_a"), given("training").alias("_t"))
    out = decisions.join(a, "doc_id", "left").fillna(0, ["review_tasks", "reviewed"])
    status = F.when(F.col("review_tasks") == 0, "not_required").when(F.col("reviewed") >= F.col("review_tasks"), "reviewed").otherwise("pending")
    return out.select("doc_id", F.coalesce("_a", "action").alias("action"), F.coalesce("_t", "training").alias("training"), status.alias("review_status"), "review_tasks", "reviewed", F.when(F.col("reviewed") > 0, "human_review").otherwise("initial_policy_decision").alias("source"))


def without_overlap(new: DataFrame, old: DataFrame, kind: str = "risk_type") -> DataFrame:
    """New findings that overlap no old one of their kind in their document."""
    o = old.select(F.col("doc_id").alias("_d"), F.col(kind).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return new.join(o, (F.col("doc_id") == F.col("_d")) & (F.col(kind) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_anti")


def repaired_span(text: Column, start: Column, end: Column, value: Column) -> Column:
    """struct<start, end>: the span as given if it holds the value (or none is given), else the only place where the value stands, else null."""
    there = (start >= 0) & (end > start) & (end <= F.length(text)) & ((value == "") | (F.substr(text, start + 1, end - start) == value))
    at = F.position(value, text)
    again = F.position(value, text, at + 1)
    only = (value != "") & (at > 0) & (again == 0)
    return F.when(there, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).when(only, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(value)).cast("int").alias("end")))


# Weights and check characters of an identity card's number.
WEIGHTS, CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"


def valid_id_card(value: Column) -> Column:
    """Whether a number has the shape of an identity card, a real date of birth, and its check character."""
    v = F.upper(F.trim(value))
    shape = v.rlike("^[1-9]\\d{5}(?:18|19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[\\dX]$")
    date = F.try_to_date(F.substring(v, 7, 8), "yyyyMMdd").isNotNull()
    total = sum((F.substring(v, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    return F.coalesce(shape & date & (F.substr(F.lit(CHECKS), total % 11 + 1, F.lit(1)) == F.substring(v, 18, 1)), F.lit(False))


def text_similarity(a: Column, b: Column) -> Column:
    """Of two texts without marks in small letters: length ratio if one holds the other, else Jaccard of character pairs."""
    plain = lambda t: F.lower(F.regexp_replace(t, "(?U)\\W+", ""))
    pairs = lambda t: F.when(F.length(t) <= 2, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))))
    x, y = plain(a), plain(b)
    both = F.size(F.array_intersect(pairs(x), pairs(y)))
    held = F.contains(x, y) | F.contains(y, x)
    return F.when((x == "") | (y == ""), 0.0).when(held, F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))).otherwise(both / F.size(F.array_union(pairs(x), pairs(y))))
