"""Cleaning, language, identity and source classification of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that may hold a record's text or id, in order of preference.
TEXT_KEYS = ["cleaned_text", "text", "content", "body", "document_text", "normalized_text", "payload_text"]
ID_KEYS = ["doc_id", "id", "record_id", "sample_id", "uid"]


def first_filled(*cols: Column) -> Column:
    """First value that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def doc_id_of(ids: list[Column], path: Column, line: Column, text: Column) -> Column:
    """First filled id, else a hash of where and what the record is."""
    return F.coalesce(first_filled(*ids), F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws(":", path, line.cast("string"), text), 256), 1, 12)))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def clean_text(text: Column) -> Column:
    """No-break spaces become spaces, zero-width marks go, blanks within lines collapse, at most one empty line stays.

    Unicode composition is left to :func:`lodestone.functions.kernels.nfc`.
    """
    out = F.regexp_replace(text, " ", " ")
    out = F.regexp_replace(out, "[​‌‍⁠﻿]", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " *\n *", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(out, "^\n+|\n+$", ""))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


CJK, LATIN = "一-鿿", "A-Za-z"


def language(text: Column) -> Column:
    """zh where Chinese characters are at least as many as Latin letters, en where there are Latin ones, else unknown."""
    cjk, latin = count_of(text, CJK), count_of(text, LATIN)
    return F.when((cjk > 0) & (cjk >= latin), "zh").when(latin > 0, "en").otherwise("unknown")


def language_by_share(text: Column) -> Column:
    """zh where over 0.3 of the first 1000 characters are Chinese, else en."""
    head = F.substring(text, 1, 1000)
    return F.when(count_of(head, CJK) > 0.3 * F.greatest(F.length(head), F.lit(1)), "zh").otherwise("en")


def strip_html(html: Column) -> Column:
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), "[ \t\n\r]+", " "))


# Source types by file extension.
EXTENSIONS = {
    "html": ("html", "htm", "php", "asp"),
    "pdf": ("pdf",),
    "code": ("py", "js", "java", "c", "cpp", "go", "rs"),
    "plain": ("txt", "md", "text", "csv", "json", "jsonl"),
    "audio": ("wav", "mp3", "flac", "m4a", "ogg"),
    "archive": ("zip", "tar", "gz", "7z"),
}


def source_type(mime: Column, path: Column) -> Column:
    """By exact MIME type, else extension, else any text type, else mixed."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(mime == "text/html", "html").when(mime == "application/pdf", "pdf").when(mime == "text/plain", "plain")
    for kind, names in EXTENSIONS.items():
        out = out.when(ext.isin(*names), kind)
    return out.when(mime.startswith("text/"), "plain").otherwise("mixed")


def audio_source_type(path: Column) -> Column:
    """audio, archive, repo or mixed."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*EXTENSIONS["audio"]), "audio").when(ext.isin(*EXTENSIONS["archive"]), "archive").when(path.rlike(r"\.git(/|$)"), "repo").otherwise("mixed")


def export_gate(decision: Column, disposition: Column, hold_allowed: Column) -> Column:
    """Reason why a document is not exported, or null."""
    return F.when(decision == "reject", "blocked").when(disposition.isin("P4", "P5"), "high_disposition").when(disposition.isin("P2", "P3") & ~hold_allowed, "hold_disabled")


def annotation_text(mode: Column, graded: Column, original: Column, redacted: Column) -> Column:
    """The text an annotator gets: graded lets documents without findings keep the original."""
    return F.when(mode == "original", original).when(mode == "redacted", redacted).otherwise(F.coalesce(graded, redacted))


def selected_labels(df: DataFrame, selected: list[str], label: str = "label") -> DataFrame:
    """Rows whose label is a selected one or a child of one (dotted)."""
    chosen = F.lit(False)
    for s in selected:
        chosen = chosen | (F.col(label) == s) | F.col(label).startswith(s + ".")
    return df.filter(chosen) if selected else df


def label_chain(label: Column) -> Column:
    """a.b.c -> [a.b, a.b.c]."""
    parts = F.split(label, r"\.")
    return F.transform(F.sequence(F.least(F.lit(2), F.size(parts)), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def document_views(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text, text_hash of documents that have text."""
    return docs.filter(F.trim(F.col(text)) != "").select("doc_id", F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))


# Source types that are looked through for licences.
LICENSED = ("code", "plain", "repo", "archive")


def scannable(docs: DataFrame, kinds: tuple[str, ...] = LICENSED, text: str = "text") -> DataFrame:
    """Documents of source types that are scanned, without further copies of a text (the first one stands for all)."""
    first = docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(first, "doc_id", "left_semi").filter(F.col("source_type").isin(*kinds))
