"""Cleaned audio packages: each manifest row with the first quality and lineage row that names it.

Rows name each other by any shared id, or by the base name of a file they refer to. Rows
of a side are first reduced to one a name, so a name that very many rows share makes no
pairs.

Edge cases: blank ids and paths are none; manifest rows without a path are no sources;
rows that nothing names stay, without a side row; equal rows are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that hold ids, and those that hold paths, in order.
IDS = ("audio_id", "source_id", "lineage_id")
MANIFEST_PATHS = ("clean_audio_path", "normalized_audio_path", "normalized_path", "audio_path", "path")
SIDE_PATHS = ("clean_audio_path", "normalized_path", "output_ref", "output_path")


def filled(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The named columns that there are, trimmed, null where blank."""
    return [F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in df.columns]


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "\\\\", "/"), "/", -1)


def _keys(df: DataFrame, refs: list[Column]) -> Column:
    ids = [F.concat(F.lit("id:"), c) for c in filled(df, IDS)]
    return F.array_distinct(F.array_compact(F.array(*ids, *[F.concat(F.lit("file:"), base_name(c)) for c in refs])))


def first_match(manifest: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """row, ``name``: for each manifest row that a side row names, the side row of least ``ord`` as a struct."""
    path = F.coalesce(*filled(manifest, MANIFEST_PATHS), F.lit(None).cast("string"))
    m = manifest.select("row", F.explode(_keys(manifest, [path])).alias("key"))
    s = side.select("ord", F.struct(*side.columns).alias("s"), F.explode(_keys(side, filled(side, SIDE_PATHS))).alias("key"))
    one = s.groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("s", "ord").alias("s"))
    return m.join(one, "key").groupBy("row").agg(F.min_by("s", "ord").alias(name))


def cleaned_audio(manifest: DataFrame, quality: DataFrame, lineage: DataFrame) -> DataFrame:
    """row, source_id, path, audio_id, quality_status, quality, lineage: the sources of a package. manifest has ``row``, the sides ``ord``."""
    path = F.coalesce(*filled(manifest, MANIFEST_PATHS), F.lit(None).cast("string"))
    said = filled(manifest, ("audio_id", "source_id"))
    stem = F.regexp_extract(base_name(path), r"^(.+?)(\.[^.]*)?$", 1)
    given = filled(manifest, ("quality_status",))
    m = manifest.select("row", path.alias("path"), F.coalesce(*said, stem).alias("source_id"), *(c.alias("_q") for c in given[:1])).filter("path is not null")
    out = m.join(first_match(manifest, quality, "quality"), "row", "left").join(first_match(manifest, lineage, "lineage"), "row", "left")
    status = [F.col("_q")] if given else []
    if "quality_status" in quality.columns:
        status.append(F.when(F.trim("quality.quality_status") != "", F.col("quality.quality_status")))
    return out.select("row", "source_id", "path", F.coalesce(*status, F.lit("unknown")).alias("quality_status"), "quality", "lineage")
