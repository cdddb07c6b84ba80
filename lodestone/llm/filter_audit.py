"""Filter interaction audit over the trie of all filter orders.

A filter is a failure condition on a document. The trie of all orders is walked depth
first: a step from a state (the set of filters applied so far) applies one more filter
to the state's persisted survivors. Survivors do not depend on the order in which a set
of filters was applied, so a state that two orders share is made once. Of every state
its survivors are counted, and at every edge those that the edge's filter removes.

Verdicts of the conditions are made in one pass over the texts and written, with the
labels, to the shared folder; survivor frames are filters over that table, so a lost
executor costs a scan of a few bytes a document. At most one frame a level of the trie
is persisted at a time. Figures stay in tables; only the plan's paths reach the driver.

Edge cases: null texts are empty; null parts are the empty string; a null condition is
not a failure; labels of an id count if any of its rows says 1; of rows with equal text
those with a larger id than the smallest fail the copy filter, a null id is larger than
all others, rows of equal id do not fail for each other; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, shared_dir, written

#: n filters have n! orders, a row each and step
MOST_FILTERS = 6
BLANK = r"[ \t\n\x0B\f\r]+"


def text_failures(words: Column, text: Column) -> dict[str, Column]:
    """Conditions A to D on a text and its words: short, repetitive, upper case, with marks of markup."""
    n, chars = F.size(words), F.length(text)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * (chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * chars,
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, fails_A to fails_E, good, toxic: a row a document. E: identical to the text of a smaller id, over the whole table."""
    given = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    own = text_failures(F.col("words"), F.col("text"))
    flags = written(given.select("part", "id", F.sha2("text", 256).alias("h"), *[c.alias(f"fails_{k}") for k, c in own.items()]), "verdicts")
    copies = written(flags.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("h", "first"), "copies")
    said = written(labels.filter("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")).select(F.col("doc_id").alias("id"), "good", "toxic"), "labels")
    both = flags.join(copies, "h", "left").withColumn("fails_E", F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))))
    both = both.drop("h", "first").join(said, "id", "left").drop("id")
    flag = [c for c in both.columns if c != "part"]
    out = written(both.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in sorted(flag)]), "judged")
    dropped(flags, copies, said)
    return out


def trie(base: DataFrame, filters: list[str]) -> DataFrame:
    """part, state, n, and removed_X, good_X, toxic_X of every filter X: one row for each part and state with survivors.

    ``base`` has part, fails_X for each filter, good and toxic. A state is a set of
    filters as bits, the first filter the lowest.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    spark = base.sparkSession
    root = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/states"
    paths: dict[int, str] = {}
    schema = None

    def visit(state: int, survivors: DataFrame) -> None:
        nonlocal schema
        survivors = survivors.persist()
        edges = [F.count_if(F.col(f"fails_{x}")).alias(f"removed_{x}") for x in filters]
        edges += [F.count_if(F.col(f"fails_{x}") & F.col(label)).alias(f"{label}_{x}") for x in filters for label in ("good", "toxic")]
        counts = survivors.groupBy("part").agg(F.lit(state).alias("state"), F.count("*").alias("n"), *edges)
        schema = counts.schema
        paths[state] = f"{root}/{state}"
        counts.write.parquet(paths[state])
        for k, x in enumerate(filters):
            after = state | 1 << k
            if after not in paths:  # another order of the same filters has been here
                visit(after, survivors.filter(~F.col(f"fails_{x}")))
        survivors.unpersist()

    visit(0, base)
    return spark.read.schema(schema).parquet(*paths.values())


def orders(filters: list[str]) -> list[tuple[str, int, str, int]]:
    """Every order of the filters by steps: order, step, filter, state before."""
    out = []
    for p in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(p, 1):
            out.append(("".join(filters[m] for m in p), step, filters[k], before))
            before |= 1 << k
    return out


def audit(base: DataFrame, filters: list[str]) -> DataFrame:
    """A row for each part, order and step: what the step keeps and removes, and what its filter does in all orders."""
    states = trie(base, filters)
    n = len(filters)
    full = (1 << n) - 1
    # all states of a part in one row (2**n at most), so that those without survivors count as zeros
    entry = F.struct("n", *[F.struct(F.col(f"removed_{x}").alias("removed"), F.col(f"good_{x}").alias("good"), F.col(f"toxic_{x}").alias("toxic")).alias(x) for x in filters])
    parts = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", entry))).alias("m"))
    every = parts.select("part", "m", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("state")).withColumn("own", F.col("m")[F.col("state")])
    each = every.select("part", "m", "state", F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), F.lit(1 << k).alias("bit"), F.col("own")[x].alias("lost")) for k, x in enumerate(filters)])).alias("e"))
    each = each.filter(F.col("state").bitwiseAND(F.col("e.bit")) == 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    edges = each.select("part", "state", "e.filter", "e.bit", zero(F.col("m")[F.col("state").bitwiseOR(F.col("e.bit"))]["n"]).alias("kept"), *[zero(F.col("e.lost")[c]).alias(d) for c, d in (("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    # so many orders reach a state of k filters and go on with a given one
    weight = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])
    whole = edges.groupBy("part", "filter").agg(
        F.max(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("state") + F.col("bit") == full, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.get(weight, F.bit_count("state"))).alias("shapley"),
    )
    each = edges.join(whole, ["part", "filter"]).withColumn("redundant", F.col("fails") - F.col("removed"))
    steps = base.sparkSession.createDataFrame(orders(filters), "filter_order string, step int, filter string, state int")
    return each.join(F.broadcast(steps), ["filter", "state"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


FILTERS = ["A", "B", "C", "D", "E"]


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    base = judged(docs, labels)
    out = written(audit(base, FILTERS), "audit")
    dropped(base)
    return out


OP13_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    [x FOR x IN string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') IF x <> ''] AS ws FROM documents),
f AS (SELECT part, (len(ws) < 100)::INT AS a, (100 * len(list_distinct(ws)) < 80 * len(ws))::INT AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), min(w.doc_id) OVER (PARTITION BY t) IS NOT NULL), false)::INT AS e,
    coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM k p, k q, k r, k s, k t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
z AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
y AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM z),
r AS (SELECT m.part, y.filter_order, y.step, y.bit,
    coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
    coalesce(sum(g) FILTER (fails & before = 0 AND fails & bit > 0), 0) AS good_lost, coalesce(sum(x) FILTER (fails & before = 0 AND fails & bit > 0), 0) AS toxic_lost
  FROM m, y GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
