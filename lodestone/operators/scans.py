"""Pattern, keyword, secret and licence scans with code-point offsets, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named patterns (whole matches; ASCII classes).
NAMED = {
    "email_address": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "url": r"https?://[^\s<>\"'\)\]]*",
    "ipv4_address": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "us_ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card_visa": r"\b4\d{3}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "credit_card_master": r"\b5[1-5]\d{2}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "phone_us": r"\b(?:\+1[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    "phone_cn": r"\b(?:\+86[- ]?)?1[3-9]\d{9}\b",
    "cn_id_card": r"\b\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret_key": r"\b[A-Za-z0-9/+=]{40}\b",
    "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}\b",
    "generic_api_key": r"(?i)(?:api[_-]?key|apikey|api[_-]?secret)[\"'\s:=]+[\"']?[A-Za-z0-9_\-]{16,}[\"']?",
    "private_key_header": r"-----BEGIN (?:RSA|EC|DSA|OPENSSH)? ?PRIVATE KEY-----",
    "cn_bank_card": r"\b(?:62|60|35|37|4[0-9]|5[1-5])\d{14,17}\b",
    "cn_passport": r"\b[EeGg]\d{8}\b",
}
SECRET_NAMES = ("aws_access_key", "aws_secret_key", "github_token", "generic_api_key", "private_key_header")
LICENCES = {"MIT": r"MIT License|under the MIT", "Apache-2.0": r"Apache License|Apache-2\.0", "GPL-3.0": r"GPL-3|GNU General Public", "CC-BY-NC": r"CC BY-NC"}
COPYLEFT = r"(?i)gpl|agpl|copyleft"


def spans(text: Column, pattern: str) -> Column:
    """All non-overlapping matches, array<struct<start, end, match>>: pieces between matches give the offsets."""
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    pieces = F.split(text, pattern, -1)
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, k))
        match = F.get(found, k)
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), match.alias("match")))).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), init, step, lambda acc: acc["out"])).otherwise(empty)


def _named(name: str):
    return lambda m: F.struct(F.lit(name).alias("pattern"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"))


def pattern_spans(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """doc_id, pattern, start, end, match. Rows without a match of a pattern never reach the fold."""
    parts = []
    for name, rx in patterns.items():
        hit = F.when(F.col(text).rlike(rx), spans(F.col(text), rx))
        parts.append(F.transform(hit, _named(name)))
    none = F.array().cast("array<struct<pattern:string,start:int,end:int,match:string>>")
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    return docs.select("doc_id", F.explode(every).alias("h")).select("doc_id", "h.*")


def keyword_spans(docs: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """doc_id, keyword, start, end: non-overlapping occurrences in the lower-cased text."""
    low = docs.select("doc_id", F.lower(text).alias("low"))
    quoted = {k: "".join("\\" + c if not c.isalnum() and c != " " else c for c in k.lower()) for k in keywords}
    return pattern_spans(low, quoted, "low").select("doc_id", F.col("pattern").alias("keyword"), "start", "end")


def context(text: Column, start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """What stands ``width`` characters before and after a span."""
    begin = F.greatest(start - width, F.lit(0))
    return F.substr(text, begin + 1, start - begin), F.substr(text, end + 1, F.lit(width))


def luhn_valid(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def licences(text: Column) -> Column:
    """Names of the licences a text mentions, in a fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(rx), F.lit(name)) for name, rx in LICENCES.items()]))


def is_copyleft(expression: Column) -> Column:
    return expression.rlike(COPYLEFT)
