"""Queries of evidence joins, reviews, floors and of what follows models; keys of the supplied tables give values by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import audio, entities, evidence, picture, privacy, text_prep, video
from lodestone.plans.picture_queries import _F as _PIC
from lodestone.plans.picture_queries import findings as pictures
from lodestone.plans.policy_queries import pick
from lodestone.plans.video_queries import _E, _R, frames, risks
from lodestone.queries import query, table

_SEV = ["low", "medium", "high", "critical"]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, sha256(text) AS text_hash, length(text)::INTEGER AS n FROM documents WHERE trim(text, ' ') <> ''")
def document_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_prep.document_views(table(spark, sf_dir, "documents")).select("doc_id", "text_hash", F.length("text").alias("n"))


@query("""SELECT d.doc_id FROM documents d JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) f USING (doc_id) WHERE d.doc_id % 5 IN (0, 2, 3)""")
def scannable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["code", "audio", "plain", "repo", "html"]
    return text_prep.scannable(table(spark, sf_dir, "documents").withColumn("source_type", pick(kinds, F.col("doc_id") % 5))).select("doc_id")


@query("""SELECT doc_id, ord, f.finding_id, action FROM (SELECT doc_id, ord, doc_id * 2 + ord AS finding_id FROM labels, (VALUES (0), (1)) o(ord)) f
LEFT JOIN (SELECT finding_id, arg_min(action, n) AS action FROM (SELECT doc_id * 2 AS finding_id, n, ['redact', 'keep', 'manual_review'][(doc_id + n) % 3 + 1] AS action FROM labels, (VALUES (3), (1), (2)) k(n)) GROUP BY finding_id) a USING (finding_id)""")
def first_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir)
    f = lab.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).withColumn("finding_id", F.col("doc_id") * 2 + F.col("ord"))
    a = lab.select((F.col("doc_id") * 2).alias("finding_id"), "doc_id", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("n")).withColumn("action", pick(["redact", "keep", "manual_review"], (F.col("doc_id") + F.col("n")) % 3))
    return evidence.with_first(f, a.drop("doc_id"), "finding_id", "n", ["action"])


@query("""SELECT t.finding_id, coalesce(e.event_id, -1) AS event_id FROM (SELECT doc_id AS finding_id FROM labels) t LEFT JOIN (SELECT finding_id, arg_min(event_id, ord) AS event_id FROM
  (SELECT doc_id AS event_id, doc_id % 7 * 1000 + doc_id AS ord, unnest([doc_id, doc_id + 1, doc_id * 2]) AS finding_id FROM labels WHERE doc_id % 3 = 0) GROUP BY finding_id) e USING (finding_id)""")
def target_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir)
    e = lab.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("event_id"), (F.col("doc_id") % 7 * 1000 + F.col("doc_id")).alias("ord"), F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") * 2).alias("finding_refs"))
    return evidence.target_events(lab.select(F.col("doc_id").alias("finding_id"), F.lit(-1).cast("bigint").alias("event_id")), e)


@query("SELECT s.doc_id, coalesce(p.source_id, s.doc_id % 9) AS source_id FROM labels s LEFT JOIN (SELECT doc_id % 50 AS path, min(doc_id % 9 + 100) AS source_id FROM labels WHERE doc_id % 4 = 0 GROUP BY ALL) p ON s.doc_id % 60 = p.path")
def located_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir)
    src = lab.filter("doc_id % 4 = 0").select((F.col("doc_id") % 50).alias("path"), (F.col("doc_id") % 9 + 100).alias("source_id"))
    return evidence.located_secrets(lab.select("doc_id", (F.col("doc_id") % 60).alias("path"), (F.col("doc_id") % 9).alias("scan_source")), src).select("doc_id", "source_id")


@query("SELECT d.doc_id, h.hit FROM (SELECT doc_id, doc_id % 20 AS source_id FROM documents) d JOIN (SELECT doc_id AS hit, doc_id % 25 AS source_id FROM labels WHERE doc_id % 10 = 0) h USING (source_id)")
def own_source_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = labels(spark, sf_dir).filter("doc_id % 10 = 0").select(F.col("doc_id").alias("hit"), (F.col("doc_id") % 25).alias("source_id"))
    return evidence.of_own_source(hits, table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 20).alias("source_id"))).select("doc_id", "hit")


@query("""WITH f AS (SELECT doc_id % 40 AS doc_id, doc_id AS finding_id, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 100 END AS start FROM labels), p AS (SELECT doc_id, finding_id FROM f WHERE finding_id % 4 = 1)
SELECT doc_id, finding_id FROM f WHERE start IS NULL OR finding_id IN (SELECT finding_id FROM p) OR doc_id NOT IN (SELECT doc_id FROM p)""")
def planned_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = labels(spark, sf_dir).select((F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("finding_id"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 100).alias("start"))
    return evidence.planned_or_unlocated(f, f.filter("finding_id % 4 = 1").select("doc_id", "finding_id")).select("doc_id", "finding_id")


@query("""SELECT o_custkey AS doc_id, k AS risk_type, s AS start, o_orderkey AS ord FROM (SELECT *, 'r' || (o_orderkey % 3) AS k, o_orderkey % 4 AS s, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3, o_orderkey % 4 ORDER BY o_orderkey % 17 DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("risk_type"), (k % 4).alias("start"), (k % 17).alias("confidence"), k.alias("ord"))
    return evidence.best_of(f, ["doc_id", "risk_type", "start"]).drop("confidence")


_STEPS = "SELECT user_id AS run_id, 'step' || (event_id % 9) AS step, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'p' || (event_id % 4) END AS provider, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || (event_id % 2) END AS version, event_id % 50 AS ms, event_id AS ord FROM events"


@query(f"""SELECT run_id, coalesce(string_agg(step || '=' || p, ',' ORDER BY step || '=' || p), '') AS providers, coalesce(string_agg(step || '=' || t, ',' ORDER BY step || '=' || t), '') AS timeline FROM (SELECT run_id, step,
  arg_max(CASE WHEN version <> '' THEN provider || '@' || version ELSE provider END, ord) FILTER (provider <> '') AS p, arg_max(ms, ord) FILTER (ms > 0) AS t FROM ({_STEPS}) GROUP BY ALL) GROUP BY run_id""")
def provider_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    say = lambda p, n: F.concat(F.lit(p), (e % n).cast("string"))
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), say("step", 9).alias("step"), F.when(e % 5 == 0, "").otherwise(say("p", 4)).alias("provider"), F.when(e % 3 == 0, "").otherwise(say("v", 2)).alias("version"), (e % 50).alias("ms"), e.alias("ord"))
    return evidence.provider_manifest(s)


_RULES = """SELECT *, CASE WHEN s1 = 0 OR s2 = 0 THEN 'reject' WHEN s4 <= 0.3 OR s3 <= 0.3 THEN 'quarantine' WHEN s5 <= 0.6 OR s2 <= 0.5 THEN 'review' ELSE 'allow' END AS decision FROM (SELECT *, CASE WHEN secrets > 0 THEN 0 ELSE 1 END AS s1, CASE lv WHEN 'unsafe' THEN 0 WHEN 'controversial' THEN 0.5 ELSE 1 END AS s2,
  CASE WHEN pii > 5 THEN 0.3 WHEN pii > 0 THEN 0.7 ELSE 1 END AS s3, CASE WHEN comp > 0 THEN 0.2 ELSE 1 END AS s4, CASE WHEN hits > 20 THEN 0.2 WHEN hits > 5 THEN 0.6 ELSE 1 END AS s5
  FROM (SELECT o_orderkey AS doc_id, o_custkey % 10 AS grp, CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 0 END AS secrets, ['safe', 'safe', 'safe', 'controversial', 'unsafe', 'safe', 'safe'][o_orderkey % 7 + 1] AS lv, o_custkey % 9 AS pii, CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS comp, o_orderkey % 13 + o_orderkey % 12 AS hits FROM orders))"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), (c % 10).alias("grp"), F.when(k % 31 == 0, 2).otherwise(0).alias("secrets"), pick(["safe", "safe", "safe", "controversial", "unsafe", "safe", "safe"], k % 7).alias("safety_level"), (c % 9).alias("pii"),
        F.when(k % 11 == 0, 3).otherwise(0).alias("compliance"), (k % 13).alias("keywords"), (k % 12).alias("regexes"),
    )


@query(f"""SELECT doc_id, s1::DOUBLE AS s_secrets, s2::DOUBLE AS s_safety, s3::DOUBLE AS s_privacy, s4::DOUBLE AS s_compliance, s5::DOUBLE AS s_text, decision, concat_ws('; ', CASE WHEN secrets > 0 THEN 'found ' || secrets || ' leaked secret(s)' END, CASE WHEN lv <> 'safe' THEN 'content classified as ' || upper(lv) END,
  CASE WHEN pii > 5 THEN 'high PII density: ' || pii || ' entities' END, CASE WHEN comp > 0 THEN comp || ' license compliance issue(s)' END) AS reasons FROM ({_RULES})""")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.rule_scores(_counts(spark, sf_dir))


@query(f"SELECT grp, ['allow', 'review', 'quarantine', 'reject'][max(list_position(['allow', 'review', 'quarantine', 'reject'], decision))] AS overall FROM ({_RULES}) GROUP BY grp")
def rule_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return evidence.overall(evidence.rule_scores(c).join(c.select("doc_id", "grp"), "doc_id"), ["grp"])


@query(f"""SELECT doc_id, CASE WHEN t IS NULL THEN 'none' ELSE {_SEV}[t] END AS risk_level, CASE WHEN t IS NULL THEN 'passed' WHEN t >= 3 THEN 'failed' ELSE 'review' END AS conclusion
FROM documents LEFT JOIN (SELECT doc_id, max(doc_id % 4 + 1) AS t FROM labels GROUP BY doc_id) USING (doc_id)""")
def conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.conclusions(labels(spark, sf_dir).select("doc_id", pick(_SEV, F.col("doc_id") % 4).alias("severity")), table(spark, sf_dir, "documents"))


@query("""WITH h AS (SELECT l_orderkey AS image_id, (l_partkey % 256)::INTEGER AS level, l_suppkey % 5 AS n FROM lineitem), s AS (SELECT image_id, level, sum(n) AS n FROM h GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY level) AS c, sum(n) OVER (PARTITION BY image_id) AS t FROM s) SELECT image_id, coalesce(min(level) FILTER (t > 0 AND c >= t * 0.75), 255)::INTEGER AS level FROM c GROUP BY image_id""")
def histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 256).cast("int").alias("level")).agg(F.sum(F.col("l_suppkey") % 5).alias("n"))
    return evidence.percentile_level(h, "image_id", 0.75)


_ACT = ["keep", "redact", "generalize", "manual_review", "exclude_from_training", "reject", "restricted_review"]
_FLOORS = f"""WITH fr AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'privacy' ELSE 'content' END AS chain, {_ACT}[doc_id % 7 + 1] AS action FROM labels WHERE doc_id % 5 = 0), lo AS (SELECT doc_id, doc_id % 9 = 0 AS degraded, {_SEV}[doc_id % 4 + 1] AS severity FROM labels WHERE doc_id % 3 = 0),
aa AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'privacy' ELSE 'content' END AS chain, {_ACT}[doc_id % 11 % 7 + 1] AS action, doc_id % 13 <> 0 AS may FROM labels WHERE doc_id % 2 = 0), ev AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'privacy' ELSE 'content' END AS chain, doc_id % 5 AS f FROM labels),
x AS (SELECT doc_id, CASE WHEN chain = 'privacy' THEN CASE action WHEN 'redact' THEN 1 WHEN 'generalize' THEN 2 WHEN 'manual_review' THEN 3 WHEN 'exclude_from_training' THEN 3 ELSE 0 END ELSE CASE action WHEN 'restricted_review' THEN 2 WHEN 'manual_review' THEN 3 WHEN 'exclude_from_training' THEN 4 WHEN 'reject' THEN 4 ELSE 0 END END AS f FROM fr
 UNION ALL SELECT doc_id, CASE WHEN degraded THEN 3 WHEN doc_id IN (SELECT doc_id FROM fr WHERE chain = 'content') THEN 0 WHEN severity IN ('critical', 'high') THEN 3 WHEN severity = 'medium' THEN 2 ELSE 1 END FROM lo
 UNION ALL SELECT doc_id, f FROM ev WHERE (doc_id, chain) NOT IN (SELECT (doc_id, chain) FROM aa WHERE may)
 UNION ALL SELECT doc_id, CASE WHEN NOT may THEN 0 WHEN chain = 'privacy' THEN CASE action WHEN 'keep' THEN 0 WHEN 'redact' THEN 1 WHEN 'generalize' THEN 2 WHEN 'manual_review' THEN 3 WHEN 'exclude_from_training' THEN 3 ELSE 1 END
   ELSE CASE action WHEN 'keep' THEN 0 WHEN 'restricted_review' THEN 2 WHEN 'manual_review' THEN 3 WHEN 'exclude_from_training' THEN 4 WHEN 'reject' THEN 4 ELSE 3 END END FROM aa)"""


@query(_FLOORS + " SELECT d.doc_id, 'P' || coalesce(max(f), 0) AS disposition FROM documents d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id")
def document_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir)
    fr = lab.filter("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "privacy").otherwise("content").alias("chain"), pick(_ACT, F.col("doc_id") % 7).alias("action"))
    lo = lab.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 9 == 0).alias("degraded"), pick(_SEV, F.col("doc_id") % 4).alias("severity"))
    aa = lab.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 < 2, "privacy").otherwise("content").alias("chain"), pick(_ACT, F.col("doc_id") % 11 % 7).alias("action"), (F.col("doc_id") % 13 != 0).alias("may_raise"))
    ev = lab.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "privacy").otherwise("content").alias("chain"), (F.col("doc_id") % 5).cast("int").alias("floor"))
    return evidence.document_floor(table(spark, sf_dir, "documents"), fr, lo, aa, ev)


@query("SELECT doc_id, " + ", ".join("CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{evidence.DONE[f'P{i}'][k]}'" for i in range(6)) + f" END AS {n}" for k, n in enumerate(("actions", "strategy", "escalation"))) + " FROM labels")
def disposition_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("doc_id", *evidence.actions_of(F.concat(F.lit("P"), (F.col("doc_id") % 6).cast("string"))))


@query("""WITH t AS (SELECT doc_id % 60 AS doc_id, doc_id AS finding_id, doc_id AS ord FROM labels WHERE doc_id % 60 < 45), r AS (SELECT doc_id AS finding_id, CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'mask' || doc_id % 3 END AS action, CASE WHEN doc_id % 5 = 1 THEN '' ELSE 'blocked' || doc_id % 2 END AS training FROM labels WHERE doc_id % 3 <> 1),
a AS (SELECT doc_id, count(*) AS n, count(r.finding_id) AS m, arg_max(action, ord) FILTER (action <> '') AS x, arg_max(training, ord) FILTER (training <> '') AS y FROM t LEFT JOIN r USING (finding_id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(x, 'retain') AS action, coalesce(y, 'allowed') AS training, CASE WHEN coalesce(n, 0) = 0 THEN 'not_required' WHEN m >= n THEN 'reviewed' ELSE 'pending' END AS review_status, coalesce(n, 0)::BIGINT AS review_tasks, coalesce(m, 0)::BIGINT AS reviewed,
  CASE WHEN coalesce(m, 0) > 0 THEN 'human_review' ELSE 'initial_policy_decision' END AS source FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id < 60) d LEFT JOIN a USING (doc_id)""")
def privacy_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labels(spark, sf_dir)
    t = lab.select((F.col("doc_id") % 60).alias("doc_id"), F.col("doc_id").alias("finding_id"), F.col("doc_id").alias("ord")).filter("doc_id < 45")
    r = lab.filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("finding_id"), F.lit(1).alias("submitted"), F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.concat(F.lit("mask"), (F.col("doc_id") % 3).cast("string"))).alias("action"), F.when(F.col("doc_id") % 5 == 1, "").otherwise(F.concat(F.lit("blocked"), (F.col("doc_id") % 2).cast("string"))).alias("training"))
    d = table(spark, sf_dir, "documents").filter("doc_id < 60").select("doc_id", F.lit("retain").alias("action"), F.lit("allowed").alias("training")).distinct()
    return evidence.privacy_final(d, t, r)


@query("""WITH f AS (SELECT doc_id % 30 AS doc_id, doc_id AS id, 'r' || (doc_id % 2) AS risk_type, doc_id % 200 AS start, doc_id % 200 + 9 AS "end" FROM labels) SELECT id FROM f n WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.id % 2 = 0 AND o.doc_id = n.doc_id AND o.risk_type = n.risk_type AND n.start < o."end" AND n."end" > o.start)""")
def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = labels(spark, sf_dir).select((F.col("doc_id") % 30).alias("doc_id"), F.col("doc_id").alias("id"), F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")).alias("risk_type"), (F.col("doc_id") % 200).alias("start"), (F.col("doc_id") % 200 + 9).alias("end"))
    return evidence.without_overlap(f.filter("id % 2 = 1"), f.filter("id % 2 = 0")).select("id")


@query("""WITH d AS (SELECT doc_id, text, doc_id % 50 AS s, doc_id % 50 + 8 AS e, CASE doc_id % 4 WHEN 0 THEN substr(text, (doc_id % 50 + 1)::INT, 8) WHEN 1 THEN substr(text, 3, 12) WHEN 2 THEN 'the' ELSE '' END AS v FROM documents),
x AS (SELECT *, e <= length(text) AND (v = '' OR substr(text, (s + 1)::INT, 8) = v) AS there, strpos(text, v) AS p FROM d)
SELECT doc_id, coalesce(CASE WHEN there THEN s WHEN v <> '' AND p > 0 AND strpos(substr(text, p + 1), v) = 0 THEN p - 1 END, -1)::INTEGER AS start, coalesce(CASE WHEN there THEN e WHEN v <> '' AND p > 0 AND strpos(substr(text, p + 1), v) = 0 THEN p - 1 + length(v) END, -1)::INTEGER AS "end" FROM x""")
def repaired_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("text"), (F.col("doc_id") % 50).cast("int")
    v = F.when(F.col("doc_id") % 4 == 0, F.substr(t, s + 1, F.lit(8))).when(F.col("doc_id") % 4 == 1, F.substring(t, 3, 12)).when(F.col("doc_id") % 4 == 2, "the").otherwise("")
    r = evidence.repaired_span(t, s, s + 8, v)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(r["start"], F.lit(-1)).alias("start"), F.coalesce(r["end"], F.lit(-1)).alias("end"))


_ID = "('110105' || (1930 + o_orderkey % 70) || lpad((1 + o_orderkey % 13)::VARCHAR, 2, '0') || lpad((1 + o_custkey % 31)::VARCHAR, 2, '0') || lpad((o_orderkey % 1000)::VARCHAR, 3, '0'))"


@query(f"""SELECT o_orderkey, coalesce(regexp_full_match(id, '[1-9]\\d{{5}}(18|19|20)\\d{{2}}(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])\\d{{3}}[\\dX]') AND try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL
  AND substr('10X98765432', (list_sum(list_transform(range(1, 18), lambda i: substr(id, i, 1)::INT * {list(evidence.WEIGHTS)}[i])) % 11 + 1)::INT, 1) = substr(id, 18, 1), false) AS valid
FROM (SELECT o_orderkey, {_ID} || substr('10X98765432', (o_orderkey % 11 + 1)::INT, 1) AS id FROM orders)""")
def identity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    v = F.concat(F.lit("110105"), (1930 + k % 70).cast("string"), pad(1 + k % 13, 2), pad(1 + c % 31, 2), pad(k % 1000, 3), F.substr(F.lit("10X98765432"), (k % 11 + 1).cast("int"), F.lit(1)))
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence.valid_id_card(v).alias("valid"))


_PL = lambda c: f"lower(regexp_replace({c}, '[^0-9A-Za-z_]+', '', 'g'))"
_PR = lambda c: f"CASE WHEN length({c}) <= 2 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"


@query(f"""SELECT p_partkey, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE len(list_intersect({_PR('x')}, {_PR('y')})) / len(list_distinct(list_concat({_PR('x')}, {_PR('y')}))) END, 9)::DOUBLE AS s
FROM (SELECT p_partkey, {_PL('p_name')} AS x, {_PL('p_type')} AS y FROM part)""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(evidence.text_similarity(F.col("p_name"), F.col("p_type")), 9).alias("s"))


_SEL = ["phone", "credential", "education_record"]
_KINDS = [*privacy.IDENTITY, "phone", "api_key", "secret", "score_record", "education_record", "email", "token"]


@query(f"SELECT doc_id, r AS risk_type FROM (SELECT doc_id, {_KINDS}[doc_id % {len(_KINDS)} + 1] AS r FROM labels) WHERE r IN ('phone', 'phone_number', 'credential', 'secret', 'api_key', 'token', 'password', 'education_record', 'score_record', 'disciplinary_record')")
def selected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.selected_entities(labels(spark, sf_dir).select("doc_id", pick(_KINDS, F.col("doc_id") % len(_KINDS)).alias("risk_type")), _SEL)


# ---- video


@query(f"""WITH e AS (SELECT *, (frame_id // 7) * 7 AS src FROM ({_E})), r AS (SELECT frame_id, 'r' || frame_id AS result FROM e WHERE frame_id % 3 = 0 AND frame_id > 40),
j AS (SELECT e.*, coalesce(a.result, b.result) AS x FROM e LEFT JOIN r a USING (frame_id) LEFT JOIN r b ON b.frame_id = e.src) SELECT * FROM (SELECT asset_id, frame_id, last_value(x IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY pts_ms, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS result FROM j) WHERE result IS NOT NULL""")
def frame_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("source_frame", F.floor(F.col("frame_id") / 7) * 7)
    r = f.filter("frame_id % 3 = 0 and frame_id > 40").select("frame_id", F.concat(F.lit("r"), F.col("frame_id").cast("string")).alias("result"))
    return video.frame_results(f, r)


@query(f"""SELECT asset_id, ['pass_raw', 'pass_redacted', 'drop'][greatest(f, coalesce(a, 0)) + 1] AS decision FROM (SELECT asset_id, max(CASE WHEN asset_id % 5 = 0 AND frame_id % 50 = 0 THEN 2 WHEN asset_id % 2 = 0 AND frame_id % 10 = 0 THEN 1 ELSE 0 END) AS f FROM ({_E}) GROUP BY asset_id)
LEFT JOIN (SELECT DISTINCT asset_id, CASE asset_id % 7 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS a FROM ({_E}) WHERE asset_id <> 4) USING (asset_id)""")
def video_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, a = F.col("frame_id"), F.col("asset_id")
    fr = frames(spark, sf_dir)
    d = fr.select("asset_id", F.when((a % 5 == 0) & (f % 50 == 0), "drop").when((a % 2 == 0) & (f % 10 == 0), "pass_redacted").otherwise("pass_raw").alias("decision"))
    sound = fr.filter("asset_id <> 4").select("asset_id").distinct().select("asset_id", pick(["allow", "reject", "quarantine", "review", "allow", "allow", "allow"], a % 7).alias("audio"))
    return video.aggregate_policy(d, sound)


_CAT = ["face", "Phone_Number", "badge", "poster", "", "person", "qr_code", "crowd"]
_REA = ["", "SEXUAL_POSE", "violence_scene", "HATE", "self_harm", "phone seen", "address line"]


@query(f"""SELECT l_orderkey, l_linenumber, c AS category, CASE WHEN c IN ('content.sexual_minor', 'content.graphic_violence') THEN 'critical' WHEN starts_with(c, 'content.') OR c IN ('privacy.id_card', 'privacy.phone', 'privacy.address') THEN CASE WHEN s >= 0.7 THEN 'high' ELSE 'medium' END
  WHEN c IN ('privacy.face', 'privacy.license_plate', 'privacy.qr_code') THEN CASE WHEN s >= 0.5 THEN 'medium' ELSE 'low' END WHEN l_partkey % 3 = 0 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, (l_partkey % 100) / 100.0 AS s, CASE k WHEN 'face' THEN 'privacy.face' WHEN 'phone_number' THEN 'privacy.phone' WHEN 'badge' THEN 'privacy.badge' WHEN 'qr_code' THEN 'privacy.qr_code'
  ELSE CASE WHEN contains(r, 'sexual') THEN 'content.sexual' WHEN contains(r, 'violence') THEN 'content.violence' WHEN contains(r, 'hate') THEN 'content.hate' WHEN contains(r, 'self_harm') THEN 'content.self_harm' WHEN contains(r, 'phone') THEN 'privacy.phone' WHEN contains(r, 'address') THEN 'privacy.address' ELSE 'visual.' || CASE WHEN k = '' THEN 'unknown' ELSE k END END END AS c
  FROM (SELECT *, lower({_CAT}[l_partkey % 8 + 1]) AS k, lower({_REA}[l_suppkey % 7 + 1]) AS r FROM lineitem))""")
def risk_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    c = video.category_of(pick(_CAT, p % 8), pick(_REA, F.col("l_suppkey") % 7))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("category"), p)
    return out.select("l_orderkey", "l_linenumber", "category", video.severity_of(F.col("category"), (p % 100) / 100.0, p % 3 == 0).alias("severity"))


@query(f"SELECT risk_id FROM ({_R}) WHERE risk_id % 8 NOT IN (2, 5) AND category NOT IN ('privacy.face', 'content.hate') AND 't' || (risk_id % 6) <> 't3'")
def selected_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("risk_id")
    r = risks(spark, sf_dir).withColumns({"operator_id": F.concat(F.lit("vpi_00"), (k % 8).cast("string")), "source_operator_id": F.lit(""), "target_type": F.concat(F.lit("t"), (k % 6).cast("string"))})
    return video.allowed_by_selection(r, ["VPI_002", " vpi_005"], ["Privacy.Face", "content.hate", "T3"]).select("risk_id")


@query("""WITH b AS (SELECT user_id % 200 AS track_id, epoch_ns(ts) // 1000000 AS t, event_id, (event_id % 90)::DOUBLE AS x, (event_id % 70)::DOUBLE AS y, (5 + event_id % 13)::DOUBLE AS w, (5 + event_id % 11)::DOUBLE AS h FROM events WHERE event_id % 40 < 2),
l AS (SELECT *, lag(x) OVER v AS x0, lag(y) OVER v AS y0, lag(w) OVER v AS w0, lag(h) OVER v AS h0 FROM b WINDOW v AS (PARTITION BY track_id ORDER BY t, event_id)),
o AS (SELECT *, greatest(least(x + w, x0 + w0) - greatest(x, x0), 0) * greatest(least(y + h, y0 + h0) - greatest(y, y0), 0) AS o FROM l)
SELECT track_id, coalesce(bool_or(o / (w * h + w0 * h0 - o) < 0.02 AND (least(w * h, w0 * h0) / greatest(w * h, w0 * h0) < 0.18 OR sqrt((x + w / 2 - x0 - w0 / 2) ** 2 + (y + h / 2 - y0 - h0 / 2) ** 2) > greatest(80, 4 * sqrt(w0 * w0 + h0 * h0)))), false) AS unstable FROM o GROUP BY track_id""")
def unstable_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("frame_id")
    s = frames(spark, sf_dir).filter("frame_id % 40 < 2").select((F.col("asset_id") % 200).alias("track_id"), "pts_ms", "frame_id", g.box(e % 90, e % 70, 5 + e % 13, 5 + e % 11).alias("box"))
    return video.unstable_tracks(s)


@query(f"""WITH r AS (SELECT *, CASE WHEN risk_id % 4 = 0 THEN risk_id + 10 END AS parent FROM ({_R})), e AS (SELECT * FROM r WHERE risk_id % 30 = 0)
SELECT e.asset_id, e.risk_id AS event_id, count(r.risk_id) AS supports FROM e LEFT JOIN r ON r.asset_id = e.asset_id AND r.start_ms <= e.end_ms + 250 AND e.start_ms <= r.end_ms + 250 AND (coalesce(r.parent = e.risk_id, false) OR (r.modality = 'safety' AND r.category = e.category)) GROUP BY ALL""")
def supported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("risk_id")
    r = risks(spark, sf_dir).withColumn("parent_id", F.when(k % 4 == 0, k + 10))
    return video.supported_events(r.filter("risk_id % 30 = 0").select("asset_id", k.alias("event_id"), "start_ms", "end_ms", "category"), r)


@query(f"""SELECT asset_id, risk_id, row_number() OVER (PARTITION BY asset_id ORDER BY start_ms, CASE risk_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, risk_id)::INTEGER - 1 AS place FROM ({_R})""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risks(spark, sf_dir).withColumn("role", pick(["primary_event", "primary_privacy", "primary_object", ""], F.col("risk_id") % 4))
    return video.display_order(r.unionByName(r))


@query(f"SELECT frame_id, bit_count(xor(frame_id * 2654435761, frame_id * 40503)) / 64.0::DOUBLE AS distance FROM ({_E})")
def hash_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("frame_id")
    return frames(spark, sf_dir).select("frame_id", video.hash_distance(f * 2654435761, f * 40503).alias("distance"))


# ---- pictures


@query(f"SELECT id, round(x - p, 6) AS x, round(w + 2 * p, 6) AS w, round(h + 2 * p, 6) AS h FROM (SELECT *, greatest(3, least(16, h * 0.08))::DOUBLE AS p FROM ({_PIC}))")
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = picture.text_region(F.col("box"))
    return pictures(spark, sf_dir).select("id", *[F.round(b[n], 6).alias(n) for n in "xwh"])


@query("SELECT l_orderkey, l_linenumber, (40 + l_partkey % 300) * (30 + l_suppkey % 90) / 120000.0 <= CASE WHEN length(regexp_replace(l_comment, '[^0-9A-Za-z_]+', '', 'g')) BETWEEN 1 AND 40 THEN 0.08 ELSE 0.2 END AS ok FROM (SELECT *, repeat(l_returnflag || l_linestatus, (l_orderkey % 40)::INT) AS l_comment FROM lineitem)")
def reasonable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.box(F.lit(0), F.lit(0), 40 + F.col("l_partkey") % 300, 30 + F.col("l_suppkey") % 90)
    t = F.expr("repeat(concat(l_returnflag, l_linestatus), cast(l_orderkey % 40 as int))")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", picture.reasonable_region(b, t, 400.0, 300.0).alias("ok"))


@query(f"""WITH f AS (SELECT *, CASE id % 3 WHEN 0 THEN '138-1234 ' || (1000 + id % 9000) WHEN 1 THEN 'call me ' || id ELSE 'AB12' END AS t FROM ({_PIC})), c AS (SELECT * FROM f WHERE category = 'qr_code'), p AS (SELECT * FROM f WHERE finding_type = 'text_pii')
SELECT id FROM p WHERE NOT (category = 'phone_number' AND id % 3 = 0 AND EXISTS (SELECT 1 FROM c WHERE c.image_id = p.image_id AND greatest(0, least(p.x + p.w, c.x + c.w) - greatest(p.x, c.x)) / least(p.w, c.w) >= 0.45 AND
  ((p.x >= c.x - c.w * 0.15 AND p.y >= c.y - c.h * 0.25 AND p.x + p.w <= c.x + c.w * 1.15 AND p.y + p.h <= c.y + c.h * 1.25) OR (p.y >= c.y AND p.y <= c.y + c.h + greatest(8, c.h * 0.55)) OR (p.y + p.h <= c.y + c.h AND p.y + p.h >= c.y - greatest(6, c.h * 0.25)))))""")
def texts_beside_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    f = pictures(spark, sf_dir).withColumn("text", F.when(i % 3 == 0, F.concat(F.lit("138-1234 "), (1000 + i % 9000).cast("string"))).when(i % 3 == 1, F.concat(F.lit("call me "), i.cast("string"))).otherwise("AB12"))
    return picture.without_code_texts(f.filter("finding_type = 'text_pii'"), f).select("id")


@query(f"""SELECT id, round(score + greatest(2 * o / (w * h + 4000 - o), CASE WHEN x + w / 2 BETWEEN 60 - 37.5 AND 60 + 87.5 AND y + h / 2 BETWEEN 50 - 60 AND 50 + 140 THEN 0.35 ELSE 0 END) - 2 * greatest(0, w * h / 120000 - CASE WHEN category = 'explicit' THEN 0.2 ELSE 0.35 END), 6)::DOUBLE AS quality
FROM (SELECT *, greatest(least(x + w, 110) - greatest(x, 60), 0) * greatest(least(y + h, 130) - greatest(y, 50), 0) AS o FROM ({_PIC}))""")
def localisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = g.box(F.lit(60), F.lit(50), F.lit(50), F.lit(80))
    q = picture.localisation_quality(F.col("box"), hint, F.col("score"), F.col("category") == "explicit", 400.0, 300.0)
    return pictures(spark, sf_dir).select("id", F.round(q, 6).alias("quality"))


# ---- sound


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN role WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN 'quality' WHEN turn % 3 = 0 THEN 'metadata' ELSE 'probe' END AS title FROM conversations")
def metadata_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    v = audio.first_value(F.when(t % 4 == 0, F.col("role")).otherwise(""), F.when((t % 4 == 1) & (c % 2 == 0), "quality"), F.when(t % 3 == 0, "metadata").otherwise(" "), F.lit("probe"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", v.alias("title"))


@query("""WITH r AS (SELECT DISTINCT conv_id AS source_id, (conv_id % 90 + 10)::DOUBLE AS duration FROM conversations), s AS (SELECT conv_id AS source_id, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS sp, turn::DOUBLE AS a, CASE WHEN turn % 2 = 0 THEN 0 ELSE turn + 1 END::DOUBLE AS b FROM conversations WHERE conv_id % 4 <> 0)
SELECT r.source_id, CASE WHEN s.source_id IS NULL OR sp = '' THEN 'speaker_0' ELSE sp END AS speaker_id, coalesce(a, 0)::DOUBLE AS start_time, CASE WHEN s.source_id IS NULL OR b = 0 THEN duration ELSE b END AS end_time, CASE WHEN s.source_id IS NULL THEN 0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN s.source_id IS NULL THEN 'fallback' ELSE 'sidecar' END AS engine FROM r LEFT JOIN s USING (source_id)""")
def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    r = c.select(F.col("conv_id").alias("source_id"), (F.col("conv_id") % 90 + 10).cast("double").alias("duration")).distinct()
    s = c.filter("conv_id % 4 <> 0").select(F.col("conv_id").alias("source_id"), F.when(t % 3 == 0, "").otherwise(F.col("role")).alias("speaker_id"), t.cast("double").alias("start_time"), F.when(t % 2 == 0, 0.0).otherwise((t + 1).cast("double")).alias("end_time"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("engine"))
    return audio.speaker_segments(r, s)


_FAM = lambda v: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in ws) + f" THEN '{(lv, c)[v]}'" for lv, c, ws in audio.FAMILIES) + f" ELSE '{('safe', '')[v]}' END"


@query(f"SELECT conv_id, turn, {_FAM(0)} AS level, {_FAM(1)} AS category FROM (SELECT conv_id, turn, lower(coalesce(text, '')) || CASE turn % 5 WHEN 1 THEN ' protest' WHEN 2 THEN ' self harm' WHEN 3 THEN ' 歧视' ELSE '' END AS l FROM conversations)")
def audio_moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    said = F.concat(F.coalesce("text", F.lit("")), F.when(t % 5 == 1, " protest").when(t % 5 == 2, " self harm").when(t % 5 == 3, " 歧视").otherwise(""))
    m = audio.moderation(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", m["level"].alias("level"), m["category"].alias("category"))


@query()
def transcript_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents")
    return entities.without_overlaps(entities.recalled(c)).drop("match")


@query("SELECT user_id, event_type, regexp_matches(v, '清华大学|北京大学|北大') OR regexp_matches(v, '(学院|公司)$') AS public FROM (SELECT user_id, event_type, CASE event_id % 4 WHEN 0 THEN '北 大' WHEN 1 THEN event_type || '公司 ' WHEN 2 THEN '公司' || event_type ELSE event_type END AS w, replace(w, ' ', '') AS v FROM events)")
def public_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    v = F.when(e % 4 == 0, "北 大").when(e % 4 == 1, F.concat(t, F.lit("公司 "))).when(e % 4 == 2, F.concat(F.lit("公司"), t)).otherwise(t)
    return table(spark, sf_dir, "events").select("user_id", "event_type", entities.public_organisation(v).alias("public"))


_ENT = [*entities.RECOGNISED, "DATE_TIME", "NRP"]
_MAP = ", ".join(str((e, *v)) for e, v in entities.RECOGNISED.items())


@query(f"SELECT o_orderkey, risk_type, policy_tag, severity, replacement FROM (SELECT o_orderkey, {_ENT}[o_orderkey % {len(_ENT)} + 1] AS entity, o_custkey % 100 / 100.0 AS score FROM orders) JOIN (VALUES {_MAP}) m(entity, risk_type, policy_tag, severity, replacement) USING (entity) WHERE score >= 0.45")
def recognised_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select("o_orderkey", pick(_ENT, F.col("o_orderkey") % len(_ENT)).alias("entity"), (F.col("o_custkey") % 100 / 100.0).alias("score"))
    return entities.as_findings(e).select("o_orderkey", "risk_type", "policy_tag", "severity", "replacement")
