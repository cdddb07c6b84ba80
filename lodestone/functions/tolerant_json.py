"""JSON as models write it: fenced, with text around it, without some commas or closing brackets.

A text that is an object as it stands is left alone. Else it is read as tokens, and a
stack of open brackets says what is missing: a comma between two fields on lines of
their own, or brackets at the end; a comma before a closing bracket goes. What stands after the last
closing brace is cut off, so an object cut short after a brace inside a string is not
read, as the rule that this follows does not read it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|\s+|[^\s{}\[\],:"]+|"', re.DOTALL)
FIELD = re.compile(r'"[-A-Za-z0-9_一-鿿]+"')
PAIRS = {"{": "}", "[": "]"}


def unfenced(text: str) -> str:
    text = text.strip()
    if not text.startswith("```"):
        return text
    lines = text.splitlines()[1:]
    if lines and lines[-1].startswith("```"):
        lines.pop()
    return "\n".join(lines).strip()


def cut(text: str) -> str:
    """From the first opening to the last closing brace, if there are such."""
    a, z = text.find("{"), text.rfind("}")
    return text[a : z + 1] if 0 <= a < z else text


def mended(text: str) -> str:
    """The text with commas and brackets put right."""
    tokens = TOKEN.findall(cut(unfenced(text)).replace("，", ",").replace("：", ":"))
    out: list[str] = []
    open_: list[str] = []
    for k, t in enumerate(tokens):
        if t in PAIRS:
            open_.append(t)
        elif t in ("}", "]"):
            last = next((i for i in range(len(out) - 1, -1, -1) if not out[i].isspace()), -1)
            if last >= 0 and out[last] == ",":
                del out[last]
            if open_ and PAIRS[open_[-1]] == t:
                open_.pop()
        elif FIELD.fullmatch(t) and out and out[-1].isspace() and "\n" in out[-1]:
            after = next((x for x in tokens[k + 1 :] if not x.isspace()), "")
            before = next((x for x in reversed(out) if not x.isspace()), ",")
            if after == ":" and before not in ("{", "[", ",", ":"):
                out.append(",")
        out.append(t)
    return "".join(out) + "".join(PAIRS[b] for b in reversed(open_))


def as_object(text: str | None) -> str | None:
    """The text of a JSON object that can be read from ``text``, or None."""
    whole = unfenced(text or "")
    for attempt in (lambda: whole, lambda: mended(whole), lambda: cut(whole), lambda: mended(cut(whole))):
        said = attempt()
        try:
            return said if isinstance(json.loads(said), dict) else None
        except ValueError:
            continue
    return None


def read_objects(df: DataFrame, text: str, schema: str, into: str = "json") -> DataFrame:
    """Add ``into`` (a struct of ``schema``, null where nothing can be read) and ``into``_corrupt (the text then)."""
    fields = df.schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [as_object(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "_said"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _said string"
    out = df.mapInArrow(kernel, ddl)
    corrupt = F.when(F.col("_said").isNull(), F.col(text))
    return out.withColumn(into, F.from_json("_said", schema)).withColumn(f"{into}_corrupt", corrupt).drop("_said")
