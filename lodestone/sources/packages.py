"""Package readers: JSON lines, JSON documents, text files and directories become units (doc_id, text, text_hash, source_path, metadata)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import kernels
from lodestone.operators.text_prep import ID_KEYS, TEXT_KEYS, doc_id_of, first_filled, text_hash

UNIT = ["doc_id", "text", "text_hash", "source_path", "metadata"]


def _field(v: Column, key: str) -> Column:
    return F.get_json_object(v, f"$.{key}")


def record_text(v: Column) -> Column:
    """First filled text key of a JSON object, else of its payload, else of its document."""
    own = [_field(v, k) for k in TEXT_KEYS]
    return first_filled(*own, *[_field(v, f"{outer}.{k}") for outer in ("payload", "document") for k in TEXT_KEYS])


def _units(records: DataFrame) -> DataFrame:
    """record (JSON object), source_path, line -> units; records that are no object or hold no text go."""
    r = records.filter(F.ltrim("record").startswith("{")).withColumn("text", record_text(F.col("record"))).filter("text is not null")
    doc_id = doc_id_of([_field(F.col("record"), k) for k in ID_KEYS], F.col("source_path"), F.col("line"), F.col("text"))
    return r.select(doc_id.alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"), "source_path", F.coalesce(_field(F.col("record"), "metadata"), F.lit("{}")).alias("metadata"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number: files are read whole, so that numbers are a file's own."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    text = F.regexp_replace("value", "^﻿", "")
    return files.select("source_path", F.posexplode(F.split(text, "\r?\n")).alias("line", "record")).withColumn("line", F.col("line") + 1)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines, lines that are no JSON object, and records without text are left out."""
    return _units(_lines(spark, path).filter(F.trim("record") != ""))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """documents[], else records[], else the document itself or its elements."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.col("_metadata.file_path").alias("source_path"))
    many = F.coalesce(_field(F.col("v"), "documents"), _field(F.col("v"), "records"), F.when(F.ltrim("v").startswith("["), F.col("v")))
    items = F.when(many.isNotNull(), F.from_json(many, "array<string>")).otherwise(F.array("v"))
    return _units(files.select("source_path", F.posexplode(items).alias("line", "record")).withColumn("line", F.col("line") + 1))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A unit a file: its name without extension, and its decoded, stripped text; empty files go."""
    t = kernels.decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    out = t.withColumn("text", text).filter("text != ''")
    return out.select(stem.alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"), F.col("path").alias("source_path"), F.lit("{}").alias("metadata"))


def _reads(reader: Callable[[SparkSession, str], DataFrame], spark: SparkSession, path: str, glob: str) -> DataFrame | None:
    """What a reader finds under a directory; None where no file matches."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")
    if not found.limit(1).count():
        return None
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = kernels.decoded(base)
    if reader is text_files:
        stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
        t = text.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text != ''")
        return t.select(stem.alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"), F.col("path").alias("source_path"), F.lit("{}").alias("metadata"))
    one = text.filter(~F.lower(F.col("path")).rlike(r"/(metadata|manifest)[^/]*$"))
    lines = one.select(F.col("path").alias("source_path"), F.posexplode(F.split("text", "\r?\n")).alias("line", "record")).withColumn("line", F.col("line") + 1)
    return _units(lines.filter(F.trim("record") != ""))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under a directory; raw text files only where those give no unit. Metadata and manifest files are no units."""
    units = _reads(json_lines, spark, path, "*.jsonl")
    if units is not None and units.limit(1).count():
        return units
    raw = _reads(text_files, spark, path, "*.{txt,text,md}")
    return raw if raw is not None else spark.createDataFrame([], "doc_id string, text string, text_hash string, source_path string, metadata string")


def _named(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, text of the files under a directory that match, without a byte order mark; none where there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return kernels.decoded(files)


#: metadata and manifest files of a package, by name
META = r"(?i)/(metadata|manifest)[^/]*$"
#: what a unit takes from its package, and what it has where neither says anything
PACKAGE_KEYS = {"task_id": "", "tenant_id": "", "profile_id": "", "source_type": ""}


def package_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row, meta map<string,string>: the objects of all metadata and manifest files, in order of their paths and lines; a later value of a key wins.

    Files and lines that are no object are left out; values that are no strings are their JSON.
    """
    files = _named(spark, path, "*.{json,jsonl}").filter(F.col("path").rlike(META))
    whole = F.when(F.lower("path").endswith(".jsonl"), F.split("text", "\r?\n")).otherwise(F.array("text"))
    said = files.select("path", F.posexplode(whole).alias("line", "v")).filter(F.ltrim("v").startswith("{")).select("path", "line", F.from_json("v", "map<string,string>").alias("m"))
    one = said.filter("m is not null").select("path", "line", F.explode("m")).groupBy("key").agg(F.max_by("value", F.struct("path", "line")).alias("value"))
    return one.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("key", "value"))), F.create_map().cast("map<string,string>")).alias("meta"))  # as many as a package's keys


def package(spark: SparkSession, path: str) -> DataFrame:
    """Units of a package directory: those of its JSON lines and JSON documents, or of its text files where these give none.

    Besides the columns of a unit: package_id, package_kind, parser_name, and task_id, tenant_id, profile_id, source_type. A
    unit's metadata are the package's, with its own over them, as a JSON object of strings.
    """
    lines = _named(spark, path, "*.jsonl").filter(~F.col("path").rlike(META))
    lines = lines.select(F.col("path").alias("source_path"), F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r?\n")).alias("line", "record")).withColumn("line", F.col("line") + 1).filter(F.trim("record") != "")
    files = _named(spark, path, "*.json").filter(~F.col("path").rlike(META)).select(F.regexp_replace("text", "^\ufeff", "").alias("v"), F.col("path").alias("source_path"))
    many = F.coalesce(_field(F.col("v"), "documents"), _field(F.col("v"), "records"), F.when(F.ltrim("v").startswith("["), F.col("v")))
    items = files.select("source_path", F.posexplode(F.when(many.isNotNull(), F.from_json(many, "array<string>")).otherwise(F.array("v"))).alias("line", "record")).withColumn("line", F.col("line") + 1)
    units = _units(lines).unionByName(_units(items))
    if not units.limit(1).count():
        raw = _named(spark, path, "*.{txt,text,md}").withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text != ''")
        stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
        units = raw.select(stem.alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"), F.col("path").alias("source_path"), F.lit("{}").alias("metadata"))
    own = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    meta = package_metadata(spark, path).first()["meta"]  # what the package's few metadata files say
    shared = F.create_map(*[F.lit(x) for kv in sorted(meta.items()) for x in kv]).cast("map<string,string>")
    out = units.withColumn("_own", own)
    out = out.withColumn("_all", F.map_concat(F.map_filter(shared, lambda k, v: ~F.map_contains_key("_own", k)), F.col("_own")))
    given = [F.coalesce(F.col("_all")[k], F.lit(other)).alias(k) for k, other in PACKAGE_KEYS.items()]
    return out.select("doc_id", "text", "text_hash", "source_path", F.to_json("_all").alias("metadata"), F.concat(F.lit("pkg_"), F.substring(F.sha2(F.lit(path.rstrip("/")), 256), 1, 12)).alias("package_id"), F.lit("directory").alias("package_kind"), F.lit("directory_package").alias("parser_name"), *given)


PARSERS: list[tuple[Callable[[str], bool], Callable[[SparkSession, str], DataFrame]]] = [
    (lambda p: p.endswith(".jsonl"), json_lines),
    (lambda p: p.endswith(".json"), json_document),
    (lambda p: p.endswith((".txt", ".text", ".md")), text_files),
    (lambda p: True, directory),
]


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Units of all paths, each by the first parser that takes it."""
    out = None
    for p in paths:
        own = next(f for takes, f in PARSERS if takes(p.lower()))(spark, p)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no path")
    return out


def asr_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a transcript sidecar: JSON lines, or one object with segments[]; missing figures take defaults."""
    v = spark.read.text(path, wholetext=True).select("value")
    kind = "array<struct<text:string,start:double,end:double,start_time:double,end_time:double,confidence:double,language:string>>"
    whole = v.filter(F.get_json_object("value", "$.segments").isNotNull()).select(F.posexplode(F.from_json(F.get_json_object("value", "$.segments"), kind)).alias("segment", "s"))
    lines = v.filter(F.get_json_object("value", "$.segments").isNull()).select(F.posexplode(F.split("value", "\r?\n")).alias("segment", "l")).filter(F.trim("l") != "")
    lines = lines.select("segment", F.from_json("l", kind[6:-1]).alias("s"))
    s = whole.unionByName(lines).filter(F.trim("s.text") != "")
    return s.select("segment", F.col("s.text").alias("text"), F.coalesce("s.start_time", "s.start", F.lit(0.0)).alias("start_time"), F.coalesce("s.end_time", "s.end", F.lit(0.0)).alias("end_time"), F.coalesce("s.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("s.language", F.lit("unknown")).alias("language"))


def write_artifacts(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Each table as JSON lines under its numbered name; returns the paths. Files keep the partitions of the tables."""
    out = {}
    for k, (name, df) in enumerate(tables.items(), 1):
        out[name] = f"{base}/{k:02d}_{name}"
        df.write.mode("overwrite").json(out[name])
    return out


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artifact read back; a missing one is an empty table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def tool_requests(items: DataFrame) -> DataFrame:
    """One request a tool: its documents as a JSON array. items: tool, doc_id, text."""
    return items.groupBy("tool").agg(F.count("*").alias("documents"), F.to_json(F.array_sort(F.collect_list(F.struct("doc_id", "text")))).alias("request"))
