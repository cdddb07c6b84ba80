"""Audio packages, models' JSON and frame hashes, from the keys of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import tolerant_json
from lodestone.operators import picture_hash
from lodestone.queries import query, table
from lodestone.sources import audio_package


def _package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders stand for manifest rows, customers for quality rows, parts for lineage rows; a tenth of all files have one name."""
    k, c, p = F.col("o_orderkey"), F.col("c_custkey"), F.col("p_partkey")
    path = lambda n: F.when(n % 10 == 0, "in/audio.wav").otherwise(F.concat(F.lit("in/a"), n.cast("string"), F.lit(".wav")))
    name = lambda n, x: F.when(n % 4 != 0, F.concat(F.lit(x), n.cast("string"))).otherwise(" ")
    manifest = table(spark, sf_dir, "orders").select(k.alias("row"), name(k, "id").alias("audio_id"), F.when(k % 6 == 0, F.concat(F.lit("s"), (k % 100).cast("string"))).alias("source_id"), F.when(k % 9 != 0, path(k)).alias("clean_audio_path"), F.when(k % 18 == 0, "x\\y\\" + "late.wav").alias("path"), F.when(k % 5 == 0, "good").alias("quality_status"))
    quality = table(spark, sf_dir, "customer").select(c.alias("ord"), name(c * 2, "id").alias("audio_id"), F.concat(F.lit("s"), (c % 300).cast("string")).alias("source_id"), F.concat(F.lit("out\\"), path(c * 3)).alias("output_ref"), F.when(c % 7 != 0, F.concat(F.lit("q"), (c % 3).cast("string"))).alias("quality_status"))
    lineage = table(spark, sf_dir, "part").select(p.alias("ord"), F.lit("").alias("lineage_id"), F.when(p % 2 == 0, path(p)).otherwise("late.wav").alias("output_path"))
    return manifest, quality, lineage


_PATH = lambda n: f"CASE WHEN {n} % 10 = 0 THEN 'in/audio.wav' ELSE 'in/a' || {n} || '.wav' END"
_BASE = lambda p: f"string_split(replace({p}, chr(92), '/'), '/')[-1]"


@query(f"""WITH m AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 4 <> 0 THEN 'id' || o_orderkey END AS a, CASE WHEN o_orderkey % 6 = 0 THEN 's' || (o_orderkey % 100) END AS s, coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN {_PATH("o_orderkey")} END, CASE WHEN o_orderkey % 18 = 0 THEN 'x' || chr(92) || 'y' || chr(92) || 'late.wav' END) AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'good' END AS q FROM orders),
mk AS (SELECT DISTINCT row, unnest(list_filter(['i' || a, 'i' || s, 'f' || {_BASE("path")}], lambda x: x IS NOT NULL)) AS k FROM m),
qk AS (SELECT unnest(list_filter(['i' || CASE WHEN c_custkey * 2 % 4 <> 0 THEN 'id' || c_custkey * 2 END, 'is' || (c_custkey % 300), 'f' || {_BASE(_PATH("(c_custkey * 3)"))}], lambda x: x IS NOT NULL)) AS k, c_custkey AS ord FROM customer),
lk AS (SELECT 'f' || CASE WHEN p_partkey % 2 = 0 THEN {_BASE(_PATH("p_partkey"))} ELSE 'late.wav' END AS k, p_partkey AS ord FROM part),
q1 AS (SELECT k, min(ord) AS ord FROM qk GROUP BY k), l1 AS (SELECT k, min(ord) AS ord FROM lk GROUP BY k),
x AS (SELECT mk.row, min(q1.ord) AS qo, min(l1.ord) AS lo FROM mk LEFT JOIN q1 ON mk.k = q1.k LEFT JOIN l1 ON mk.k = l1.k GROUP BY mk.row)
SELECT m.row, coalesce(a, s, regexp_replace({_BASE("path")}, '[.][^.]*$', '')) AS source_id, path, coalesce(q, CASE WHEN qo % 7 <> 0 THEN 'q' || (qo % 3) END, 'unknown') AS quality_status, coalesce(qo, -1) AS quality_row, coalesce(lo, -1) AS lineage_row FROM m JOIN x ON m.row = x.row WHERE path IS NOT NULL""")
def cleaned_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audio_package.cleaned_audio(*_package(spark, sf_dir))
    return a.select("row", "source_id", "path", "quality_status", F.coalesce("quality.ord", F.lit(-1)).alias("quality_row"), F.coalesce("lineage.ord", F.lit(-1)).alias("lineage_row"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 5 THEN -1 ELSE c_nationkey END::BIGINT AS nation, c_custkey % 6 = 5 AS corrupt FROM customer""")
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a model might write them: plain, fenced, without a comma, with one too many, cut short; one in six is no object."""
    k, name, nation = F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey").cast("string")
    forms = [
        F.concat(F.lit('{"name": "'), name, F.lit('", "nation": '), nation, F.lit("}")), F.concat(F.lit('```json\n{"nation": '), nation, F.lit(', "name": "'), name, F.lit('"}\n```')), F.concat(F.lit('Here: {"name": "'), name, F.lit('"\n  "nation"：'), nation, F.lit(",}. Done")),
        F.concat(F.lit('{"nation": '), nation, F.lit('\n "name": "'), name, F.lit('"\n "more": [1, 2')), F.concat(F.lit('{"more": {"a": [1,]}\n"name": "'), name, F.lit('", "nation": '), nation, F.lit("}")), F.concat(F.lit("[1, "), nation, F.lit("]")),
    ]
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*forms), (k % 6 + 1).cast("int")).alias("t"))
    r = tolerant_json.read_objects(c, "t", "name string, nation bigint")
    return r.select("c_custkey", "json.name", F.coalesce("json.nation", F.lit(-1)).alias("nation"), F.col("json_corrupt").isNotNull().alias("corrupt"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events stand for frames; the 64 grey values of each come from its number, one in eleven has none."""
    e = F.col("event_id")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * (e % 9 + 3) + F.when(i == 7, e % 5 * 60).otherwise(0)) % 256).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), e.alias("frame_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("pts_ms"), F.when(e % 11 != 0, pixels).alias("pixels"))


_BITS = """SELECT user_id AS a, event_id AS f, epoch_ns(ts) // 1000000 AS t, CASE WHEN event_id % 11 <> 0 THEN [(i * (event_id % 9 + 3) + CASE WHEN i = 7 THEN event_id % 5 * 60 ELSE 0 END) % 256 FOR i IN range(0, 64)] END AS px FROM events"""
_HASH = f"SELECT a, f, t, px, CASE WHEN px IS NOT NULL THEN array_to_string([CASE WHEN p >= list_avg(px) THEN '1' ELSE '0' END FOR p IN px], '') END AS bits FROM ({_BITS})"


@query(f"SELECT f AS frame_id, array_to_string([printf('%x', 8 * substr(bits, q * 4 + 1, 1)::INT + 4 * substr(bits, q * 4 + 2, 1)::INT + 2 * substr(bits, q * 4 + 3, 1)::INT + substr(bits, q * 4 + 4, 1)::INT) FOR q IN range(0, 16)], '') AS hash FROM ({_HASH}) WHERE bits IS NOT NULL")
def frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed(spark, sf_dir).withColumn("h", picture_hash.average_hash(F.col("pixels"))).filter("h is not null")
    return h.select("frame_id", picture_hash.hash_hex(F.col("h")).alias("hash"))


@query(f"""WITH RECURSIVE h AS (SELECT a, f, bits, row_number() OVER (PARTITION BY a ORDER BY t, f) AS n FROM ({_HASH})),
s AS (SELECT a, 0::BIGINT AS n, NULL::BIGINT AS f, []::VARCHAR[] AS seen, []::BIGINT[] AS who, NULL::VARCHAR AS last, NULL::BIGINT AS chosen, NULL::BIGINT AS src, NULL::VARCHAR AS reason, NULL::DOUBLE AS d FROM (SELECT DISTINCT a FROM h)
  UNION ALL SELECT a, n, f, CASE WHEN kind = 'analysed' AND bits IS NOT NULL THEN list_append(seen, bits) ELSE seen END, CASE WHEN kind = 'analysed' AND bits IS NOT NULL THEN list_append(who, f) ELSE who END, CASE WHEN kind = 'analysed' AND bits IS NOT NULL THEN bits ELSE last END, CASE WHEN kind = 'analysed' THEN f ELSE chosen END,
    CASE kind WHEN 'analysed' THEN f WHEN 'exact_frame_hash' THEN who[list_position(seen, bits)] ELSE chosen END, kind, CASE WHEN kind = 'similar_previous_frame' THEN apart END
  FROM (SELECT *, CASE WHEN bits IS NOT NULL AND list_contains(seen, bits) THEN 'exact_frame_hash' WHEN apart <= 0.08 THEN 'similar_previous_frame' ELSE 'analysed' END AS kind FROM (SELECT s.a, h.n, h.f, seen, who, last, chosen, bits, hamming(last, bits) / 64.0::DOUBLE AS apart FROM s JOIN h ON s.a = h.a AND h.n = s.n + 1)))
SELECT a AS asset_id, f AS frame_id, src AS source_frame, reason, coalesce(d, -1.0)::DOUBLE AS distance FROM s WHERE n > 0""")
def submission_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed(spark, sf_dir).withColumn("hash", picture_hash.average_hash(F.col("pixels")))
    return picture_hash.submission_frames(h, 0.08).withColumn("distance", F.coalesce("distance", F.lit(-1.0)))
