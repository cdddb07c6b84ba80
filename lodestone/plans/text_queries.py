"""Text operators over documents, pages, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import kernels
from lodestone.operators import dedup, scans, text_prep
from lodestone.queries import query, table


@query(r"""
SELECT doc_id, length(c)::INTEGER AS clean_chars, sha256(c) AS clean_sha256
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  chr(160), ' ', 'g'), '[' || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || ']', '', 'g'), '\r\n?', chr(10), 'g'),
  '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS c FROM documents)
""")
def clean_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text_prep.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("clean_chars"), F.sha2("c", 256).alias("clean_sha256"))


@query("""
SELECT doc_id, CASE WHEN z > 0 AND z >= l THEN 'zh' WHEN l > 0 THEN 'en' ELSE 'unknown' END AS language,
  CASE WHEN z1 > 0.3 * greatest(length(h), 1) THEN 'zh' ELSE 'en' END AS language_by_share
FROM (SELECT doc_id, left(text, 1000) AS h,
  length(text) - length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', '', 'g')) AS z,
  length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS l,
  length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '[\\x{4e00}-\\x{9fff}]', '', 'g')) AS z1 FROM documents)
""".replace("\\\\", "\\"))
def language_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text_prep.language(t).alias("language"), text_prep.language_by_share(t).alias("language_by_share"))


@query("""
SELECT doc_id, sha256(c) AS nfc_sha256, length(c)::INTEGER AS nfc_chars
FROM (SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))) AS c FROM documents)
""")
def nfc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two letters taken apart into letter and mark, put together again."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    d = kernels.nfc(table(spark, sf_dir, "documents").select("doc_id", apart.alias("text")))
    return d.select("doc_id", F.sha2("text", 256).alias("nfc_sha256"), F.length("text").alias("nfc_chars"))


@query("""
SELECT doc_id::VARCHAR AS given_id, 'doc_' || left(sha256('docs.jsonl:' || doc_id || ':' || text), 12) AS made_id, sha256(text) AS text_hash
FROM documents WHERE trim(text) <> ''
""")
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    made = text_prep.doc_id_of([F.lit(""), F.lit(None).cast("string")], F.lit("docs.jsonl"), F.col("doc_id"), F.col("text"))
    given = text_prep.doc_id_of([F.lit(" "), F.col("doc_id").cast("string")], F.lit("docs.jsonl"), F.col("doc_id"), F.col("text"))
    filled = text_prep.first_filled(F.lit(""), F.col("text"))
    return d.filter(filled.isNotNull()).select(given.alias("given_id"), made.alias("made_id"), text_prep.text_hash(F.col("text")).alias("text_hash"))


@query(r"""
SELECT page_id, length(t)::INTEGER AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id,
  trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)
""")
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", text_prep.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query(r"""
SELECT page_id, CASE WHEN x IN ('html','htm','php','asp') THEN 'html' WHEN x = 'pdf' THEN 'pdf' WHEN x IN ('py','js','java','c','cpp','go','rs') THEN 'code'
  WHEN x IN ('txt','md','text','csv','json','jsonl') THEN 'plain' WHEN x IN ('wav','mp3','flac','m4a','ogg') THEN 'audio' WHEN x IN ('zip','tar','gz','7z') THEN 'archive' ELSE 'mixed' END AS source_type,
  CASE WHEN x IN ('wav','mp3','flac','m4a','ogg') THEN 'audio' WHEN x IN ('zip','tar','gz','7z') THEN 'archive' WHEN regexp_matches(url, '\.git(/|$)') THEN 'repo' ELSE 'mixed' END AS audio_source_type
FROM (SELECT page_id, url, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS x FROM pages)
""")
def source_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text_prep.source_type(F.lit(""), u).alias("source_type"), text_prep.audio_source_type(u).alias("audio_source_type"))


@query("""
SELECT doc_id, first_value(doc_id) OVER w AS duplicate_of, doc_id <> first_value(doc_id) OVER w AS is_duplicate
FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)
""")
def exact_dedup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_map(table(spark, sf_dir, "documents"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_map(table(spark, sf_dir, "documents")).groupBy(F.col("duplicate_of").alias("doc_id")).agg(F.count("*").alias("copies"))


@query()
def near_dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(table(spark, sf_dir, "documents"))


@query()
def near_dedup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every document when they are taken one by one and near copies of kept ones are dropped."""
    return dedup.near_map(table(spark, sf_dir, "documents"))


@query()
def token_jaccard_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_then_within(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.8)


# Patterns that the SQL engine reads the same way: no look-around is among them.
PLAIN = {k: v for k, v in scans.NAMED.items()}
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, unnest(regexp_extract_all(text, '{v.replace(chr(39), chr(39) * 2)}')) AS match FROM documents" for k, v in PLAIN.items())


@query(f"SELECT pattern, count(*) AS matches, count(DISTINCT doc_id) AS docs FROM ({_HITS}) GROUP BY pattern")
def regex_hits_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scans.pattern_spans(table(spark, sf_dir, "documents"), PLAIN)
    return hits.groupBy("pattern").agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT doc_id, pattern, match, count(*) AS n FROM ({_HITS}) GROUP BY ALL")
def regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches sliced out of the text by the spans found, so that offsets are checked too."""
    docs = table(spark, sf_dir, "documents")
    hits = scans.pattern_spans(docs, PLAIN).join(docs.select("doc_id", "text"), "doc_id")
    cut = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return hits.select("doc_id", "pattern", cut.alias("match")).groupBy("doc_id", "pattern", "match").agg(F.count("*").alias("n"))


KEYWORDS = ["idiot", "stupid", "trash", "licensed under", "the tion"]


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS keyword, ((length(text) - length(replace(lower(text), '{k}', ''))) // {len(k)})::BIGINT AS hits FROM documents WHERE contains(lower(text), '{k}')" for k in KEYWORDS))
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.keyword_spans(table(spark, sf_dir, "documents"), KEYWORDS).groupBy("doc_id", "keyword").agg(F.count("*").alias("hits"))


@query("""
WITH h AS (SELECT doc_id, text, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 5))::BIGINT AS start
  FROM (SELECT doc_id, text, string_split(lower(text), 'idiot') AS p FROM documents WHERE contains(lower(text), 'idiot')))
SELECT doc_id, start, substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) AS context_before, substr(text, start + 6, 40) AS context_after FROM h
""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = scans.keyword_spans(docs, ["idiot"]).select("doc_id", F.col("start").cast("bigint").alias("start"))
    before, after = scans.context(F.col("text"), F.col("start").cast("int"), F.col("start").cast("int") + 5, 40)
    return docs.join(hits, "doc_id").select("doc_id", "start", before.alias("context_before"), after.alias("context_after"))


SECRETS = "|".join(f"(?:{scans.NAMED[k]})" for k in scans.SECRET_NAMES)  # a flag holds within its group
# the same patterns, with the flag's group written as both engines read it
_SECRETS = "|".join(f"(?i:{scans.NAMED[k].removeprefix('(?i)')})" if scans.NAMED[k].startswith("(?i)") else f"(?:{scans.NAMED[k]})" for k in scans.SECRET_NAMES)


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_SECRETS.replace(chr(39), chr(39) * 2)}'))::INTEGER AS secrets FROM documents WHERE regexp_matches(text, '{_SECRETS.replace(chr(39), chr(39) * 2)}')")
def secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(SECRETS))
    return d.select("doc_id", F.size(scans.spans(F.col("text"), SECRETS)).alias("secrets"))


_LIC = ", ".join(f"CASE WHEN regexp_matches(text, '{v}') THEN '{k}' END" for k, v in scans.LICENCES.items())


@query(f"SELECT doc_id, x AS licences, regexp_matches(x, '(?i)gpl|agpl|copyleft') AS copyleft FROM (SELECT doc_id, concat_ws(' AND ', {_LIC}) AS x FROM documents) WHERE x <> ''")
def licence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array_join(scans.licences(F.col("text")), " AND ")
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("licences")).filter("licences != ''").withColumn("copyleft", scans.is_copyleft(F.col("licences")))


_CARD = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"


@query(rf"""
WITH c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_CARD}')), '[ -]', '', 'g') AS card FROM documents)
SELECT doc_id, card, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1
  THEN (2 * substr(card, i, 1)::INTEGER) // 10 + (2 * substr(card, i, 1)::INTEGER) % 10 ELSE substr(card, i, 1)::INTEGER END)) % 10 = 0 AS luhn
FROM c
""")
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scans.pattern_spans(table(spark, sf_dir, "documents"), {"card": _CARD})
    return hits.select("doc_id", F.regexp_replace("match", "[ -]", "").alias("card")).withColumn("luhn", scans.luhn_valid(F.col("card")))
