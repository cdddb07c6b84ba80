"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged by an array aggregation; pieces are concatenated into the formatted
string, with the loss mask as spans of code points that cover each assistant text.

The template marks every merged block by a begin and an end and separates the turns in
it. A control string inside a text or a role gets a backslash after its first character (one more
where it has some already), so none is left in the output but those of the template,
and taking one backslash away gives back the text: formatting is reversible.

A conversation is formatted in parts of ``PART`` turn numbers, so that no array grows
with a conversation; what stands before and after a part is looked up from figures of a
row a part. Parts joined in order are the whole conversation, and spans count from the
start of their part.

Edge cases: null texts and roles are empty ones; turns of equal number are ordered by
role and text; null turn numbers come first, in a part of their own; repeated rows are
turns of their own; null conversation ids are one conversation; roles are kept as they
are, those without marks of their own are named in the output; an empty table gives no
rows; extra columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = 256


@dataclass(frozen=True)
class Template:
    """Begin and end of a block by role, of a block of any other role (its name goes between ``named``), and what stands between merged turns."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")})
    named: tuple[str, str] = ("[ROLE]", "[SAYS] ")
    end: str = " [/ROLE]"
    between: str = " [NEXT] "
    loss: str = "assistant"
    #: what is escaped inside texts: an opening character, backslashes, and the rest of a control string
    control: str = r"([\[<])(\\*+)(/?(?:SYS|INST|OUT|ROLE|SAYS|NEXT)\]|/?s>)"
    escaped: str = r"([\[<])\\(\\*+)(/?(?:SYS|INST|OUT|ROLE|SAYS|NEXT)\]|/?s>)"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.control, r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.escaped, "$1$2$3")

    def begin(self, role: Column) -> Column:
        other = F.concat(F.lit(self.named[0]), self.escape(role), F.lit(self.named[1]))
        return self._by_role(role, {r: F.lit(m[0]) for r, m in self.marks.items()}, other)

    def close(self, role: Column) -> Column:
        return self._by_role(role, {r: F.lit(m[1]) for r, m in self.marks.items()}, F.lit(self.end))

    @staticmethod
    def _by_role(role: Column, known: dict[str, Column], other: Column) -> Column:
        out = None
        for r, c in known.items():
            out = F.when(role == r, c) if out is None else out.when(role == r, c)
        return out.otherwise(other) if out is not None else other

    def ends(self) -> list[str]:
        return [m[1].strip() for m in self.marks.values()] + [self.end.strip()]


MESSAGES = "array<struct<role:string,texts:array<string>>>"
SPANS = "array<struct<start:int,chars:int>>"


def merged(turns: Column) -> Column:
    """Sorted turns (structs of role and text) as messages: adjacent ones of one role are one message with several texts."""

    def put(have: Column, t: Column) -> Column:
        last = F.element_at(have, -1)
        same = (F.size(have) > 0) & (F.try_element_at(have, F.lit(-1))["role"] == t["role"])
        more = F.concat(F.slice(have, F.lit(1), F.size(have) - 1), F.array(F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))))
        return F.when(same, more).otherwise(F.concat(have, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))))

    return F.aggregate(turns, F.array().cast(MESSAGES), put)


def pieces(messages: Column, before: Column, after: Column, template: Template) -> Column:
    """What is written, in order: structs of role, text (whether a turn's own), out. A first message that goes on from ``before`` has no begin, a last one that ``after`` goes on has no end."""
    n = F.size(messages)
    piece = lambda role, own, out: F.struct(role.alias("role"), F.lit(own).alias("own"), out.alias("out"))

    def of_message(m: Column, k: Column) -> Column:
        role = m["role"]
        first = F.when((k == 0) & before.eqNullSafe(role), F.lit(template.between)).otherwise(template.begin(role))
        last = F.when((k == n - 1) & after.eqNullSafe(role), F.lit("")).otherwise(template.close(role))
        texts = F.transform(m["texts"], lambda t, i: F.array(piece(role, False, F.when(i == 0, first).otherwise(F.lit(template.between))), piece(role, True, template.escape(t))))
        return F.concat(F.flatten(texts), F.array(piece(role, False, last)))

    return F.flatten(F.transform(messages, of_message))


def loss_spans(written: Column, template: Template) -> Column:
    """Spans (start, chars) of the pieces that are texts of the role that is learnt; starts count code points of the part."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def put(s: Column, p: Column) -> Column:
        n = F.length(p["out"])
        span = F.array(F.struct(s["at"].alias("start"), n.alias("chars")))
        return F.struct((s["at"] + n).alias("at"), F.when(p["own"] & (p["role"] == template.loss), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(written, start, put, lambda s: s["spans"])


def formatted(rows: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """conv_id, part, n_turns int, formatted string, loss array<struct<start, chars>>: a row for every ``part`` turn numbers of a conversation.

    Only rows of one part are collected together; a conversation's parts are tied by the
    roles at their edges, which an aggregation of its own finds without the texts.
    """
    template = template or Template()
    number = F.col(turn).cast("long")
    own = rows.select(F.col(conv_id).alias("conv_id"), F.coalesce(F.floor(number / part), F.lit(-(2**62))).alias("part"), number.alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    edge = own.groupBy("conv_id", "part").agg(F.min(F.struct("turn", "role"))["role"].alias("first"), F.max(F.struct("turn", "role"))["role"].alias("last"))
    order = Window.partitionBy("conv_id").orderBy("part")
    edge = edge.select("conv_id", "part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    # alone in its conversation a part has nothing at its edges
    edge = edge.filter("before is not null or after is not null")
    got = own.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = got.join(edge.withColumnsRenamed({"conv_id": "_c", "part": "_p"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    both = both.select("conv_id", "part", "before", "after", F.size("turns").alias("n_turns"), merged(F.col("turns")).alias("messages"))
    both = both.select("conv_id", "part", "n_turns", pieces(F.col("messages"), F.col("before"), F.col("after"), template).alias("pieces"))
    return both.select("conv_id", "part", "n_turns", F.array_join(F.transform("pieces", lambda p: p["out"]), "").alias("formatted"), loss_spans(F.col("pieces"), template).alias("loss"))


def under_loss(out: Column, loss: Column, template: Template | None = None) -> Column:
    """The text that a part's loss mask covers, unescaped, nothing between."""
    template = template or Template()
    return F.array_join(F.transform(loss, lambda s: template.unescape(F.substring(out, s["start"] + 1, s["chars"]))), "")


def read_back(whole: Column, template: Template | None = None) -> Column:
    """Turns (array of structs of role and text) read from a conversation's formatted string: its joined parts."""
    template = template or Template()
    cut = "|".join(r"(?<=" + "".join("\\" + c if not c.isalnum() else c for c in e) + ")" for e in template.ends())
    blocks = F.filter(F.split(whole, cut), lambda b: b != "")

    def role_of(block: Column) -> Column:
        other = template.unescape(F.substring_index(F.substring(block, len(template.named[0]) + 1, 1 << 30), template.named[1], 1))
        out = None
        for r, m in template.marks.items():
            out = F.when(F.startswith(block, F.lit(m[0])), F.lit(r)) if out is None else out.when(F.startswith(block, F.lit(m[0])), F.lit(r))
        return out.otherwise(other)

    def texts_of(block: Column) -> Column:
        own = None
        for m in template.marks.values():
            body = F.substring(block, F.lit(len(m[0]) + 1), F.length(block) - len(m[0]) - len(m[1]))
            own = F.when(F.startswith(block, F.lit(m[0])), body) if own is None else own.when(F.startswith(block, F.lit(m[0])), body)
        at = F.instr(block, template.named[1]) + len(template.named[1])
        body = own.otherwise(F.substring(block, at, F.length(block) - at + 1 - len(template.end)))
        return F.split(body, "".join("\\" + c if not c.isalnum() and c != " " else c for c in template.between))

    of = lambda b: F.transform(texts_of(b), lambda t: F.struct(role_of(b).alias("role"), template.unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, of))


#: the conversation of control strings that the query adds
PROBE = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    parts = formatted(rows.unionByName(probe))
    parts = parts.select("conv_id", "part", "formatted", under_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "formatted", "learnt"))).alias("parts"))
    whole = whole.select("conv_id", F.array_join("parts.formatted", "").alias("formatted"), F.array_join("parts.learnt", "").alias("learnt"))
    whole = whole.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP11_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?(?:SYS|INST|OUT|ROLE|SAYS|NEXT)\]|/?s>)', '\1\\\2\3', 'g') AS esc,
    length(regexp_replace(role, '([\[<])(\\*)(/?(?:SYS|INST|OUT|ROLE|SAYS|NEXT)\]|/?s>)', '\1\\\2\3', 'g')) AS role_chars,
    lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on, lead(role) OVER w IS NOT DISTINCT FROM role AS has_next
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + CASE WHEN goes_on THEN 8 ELSE CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 6 ELSE 13 + role_chars END END
    + CASE WHEN has_next THEN 0 ELSE CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 8 WHEN 'assistant' THEN 5 ELSE 8 END END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
