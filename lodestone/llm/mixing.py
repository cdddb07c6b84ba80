"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source carries weights; a token budget is handed down
it. A child whose share exceeds what it can give (its tokens times ``max_epochs``) is
held at that, and its shortage goes to its siblings by weight; only what a whole
subtree cannot give reaches the parent's siblings. Children whose names have no stated weight
share ``REST``, so data of a new language or domain is mixed in and not lost. A leaf then takes whole epochs and
a prefix, in the seeded order of the next epoch, of texts whose tokens still fit.

Only figures per leaf reach the driver (``MAX_LEAVES`` at most, else an error). A
leaf's prefix is found without sorting the leaf: its order is cut into ``BINS`` equal
hash ranges, whose sums say in which bin the prefix ends; that bin is cut into as many
again, and only the part in which the prefix ends is sorted.

Edge cases: null or empty texts have no tokens and are taken with the prefix they
fall in; null languages and sources count as ''; equal rows have equal places in the
order and are decided together only by their running sum, so repeated rows are rows;
an empty table gives none; clashing extra columns (domain, n_tokens, n_copies) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import written

MAX_LEAVES = 100_000
#: a power of two
BINS = 512
Path = tuple[str, ...]
#: weight of a child: (path of the child, tokens below it) -> weight, or None if nothing is stated for it
Weight = Callable[[Path, int], float | None]
#: what all children without a stated weight have together, as a share of their siblings' stated weights
REST = 0.05


def stated(weights: dict[str, dict[str, float]], other: Weight) -> Weight:
    """Target weights by level and name: {"domain": {name: weight}, "lang": ...}, levels in the order of the tree; names left out share ``REST``, levels left out weigh as ``other`` says."""
    levels = list(weights.values())

    def weight(path: Path, tokens: int) -> float | None:
        k = len(path) - 1
        return levels[k].get(path[-1]) if k < len(levels) else other(path, tokens)

    return weight


def tempered(power: float) -> Weight:
    """Weights that grow with the tokens at hand to a power below 1, so that small sources gain."""
    return lambda path, tokens: float(tokens) ** power


def weights_of(kids: dict[Path, int], weight: Weight) -> dict[Path, float]:
    """Weights of the children of a node; those without a stated one share ``REST`` by their tokens."""
    said = {c: weight(c, n) for c, n in kids.items()}
    rest = {c: kids[c] for c, w in said.items() if w is None}
    whole, below = sum(max(0.0, w) for w in said.values() if w is not None), sum(rest.values())
    share = REST * whole if whole > 0 else 1.0
    return {c: max(0.0, w) if w is not None else share * (rest[c] / below if below else 1 / len(rest)) for c, w in said.items()}


def budgets(tokens: dict[Path, int], total: int, weight: Weight, max_epochs: int) -> dict[Path, int]:
    """The token budget of each leaf; they sum to ``total`` but for rounding, or to all that can be given."""
    if not tokens:
        return {}
    depth = len(next(iter(tokens)))
    below: dict[Path, dict[Path, int]] = {}  # node -> its children with their tokens
    for path, n in tokens.items():
        for k in range(depth):
            kids = below.setdefault(path[:k], {})
            kids[path[: k + 1]] = kids.get(path[: k + 1], 0) + n
    given: dict[Path, float] = {(): float(min(total, max_epochs * sum(tokens.values())))}
    for k in range(depth):
        for node in sorted(p for p in below if len(p) == k):
            kids, left = below[node], given[node]
            open_ = sorted(kids)
            every = weights_of(kids, weight)
            while open_:
                w = {c: every[c] for c in open_}
                whole = sum(w.values())
                if whole <= 0:
                    w, whole = {c: 1.0 for c in open_}, float(len(open_))
                full = [c for c in open_ if left * w[c] / whole >= max_epochs * kids[c]]
                if not full:
                    given |= {c: left * w[c] / whole for c in open_}
                    break
                for c in full:
                    given[c] = float(max_epochs * kids[c])
                    left -= given[c]
                left = max(left, 0.0)
                open_ = [c for c in open_ if c not in full]
    return {p: int(given[p] + 1e-6) for p in tokens}


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]++")).cast("long")


def default_domain(source: Column) -> Column:
    """A domain for tables that have none: one of four by the source's checksum."""
    return F.concat(F.lit("domain"), (F.crc32(source.cast("binary")) % 4).cast("string"))


def mixed(docs: DataFrame, share: float, weight: Weight, max_epochs: int = 2, seed: int = 11, levels: dict[str, Column] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add domain, n_tokens and n_copies (how often the mixture takes the row); every row is returned."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    levels = levels or {"domain": default_domain(source), "lang": lang, "source": source}
    names = [f"_l{k}" for k in range(len(levels))]
    out = docs.drop("domain", "n_tokens", "n_copies").withColumns(dict(zip(names, levels.values())) | {"n_tokens": n_words(F.col(text))})
    sums = out.groupBy(*names).agg(F.sum("n_tokens").alias("t")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    tokens = {tuple(r[n] for n in names): int(r["t"]) for r in sums}
    plan = budgets(tokens, int(share * sum(tokens.values())), weight, max_epochs)
    spark = docs.sparkSession
    kind = ", ".join(f"{n} string" for n in names)
    rows = [(*p, *(divmod(b, tokens[p]) if tokens[p] else (max_epochs, 0))) for p, b in plan.items()]
    leaves = F.broadcast(spark.createDataFrame(rows, f"{kind}, _full bigint, _rest bigint"))  # MAX_LEAVES rows at most
    order = F.xxhash64(F.lit(seed), F.col("_full"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    dealt = out.join(leaves, names).withColumn("_order", order)
    bits = BINS.bit_length() - 1

    def ended(rows: DataFrame, shift: int, before: Column) -> tuple[DataFrame, DataFrame]:
        """Rows outside the bin in which their leaf's prefix ends, with n_copies, and those in it, with _before (tokens of the prefix before the bin)."""
        rows = rows.withColumn("_bin", F.shiftright("_order", shift).bitwiseAND(BINS - 1).cast("int"))
        if shift == 64 - bits:  # the sign stands in front
            rows = rows.withColumn("_bin", F.pmod(F.col("_bin") + BINS // 2, F.lit(BINS)))
        bins = rows.groupBy(*names, "_bin").agg(F.sum("n_tokens").alias("t"), F.first("_rest").alias("r"), F.first(before).alias("b"))
        run = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows a leaf at most
        ends = bins.withColumn("c", F.col("b") + F.sum("t").over(run)).filter("c > r").groupBy(*names).agg(F.min(F.struct("_bin", (F.col("c") - F.col("t")).alias("before"))).alias("x"))
        ends = written(ends.select(*names, F.col("x._bin").alias("_end"), F.col("x.before").alias("_until")), "ends")
        rows = rows.join(F.broadcast(ends), names, "left")  # a row a leaf
        apart = rows.filter(F.col("_end").isNull() | (F.col("_bin") != F.col("_end")))
        taken = (F.col("_end").isNull() | (F.col("_bin") < F.col("_end"))) & (F.col("_full") < max_epochs)
        inside = rows.filter(F.col("_bin") == F.col("_end")).drop("_before").withColumnRenamed("_until", "_before").drop("_bin", "_end")
        return apart.withColumn("n_copies", F.col("_full") + taken.cast("long")).drop("_bin", "_end", "_until", "_before"), inside

    whole, rest = ended(dealt, 64 - bits, F.lit(0).cast("bigint"))
    more, last = ended(rest, 64 - 2 * bits, F.col("_before"))
    so_far = Window.partitionBy(*names).orderBy("_order", F.col(doc_id), F.col(text)).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("n_copies", F.col("_full") + (F.col("_before") + F.sum("n_tokens").over(so_far) <= F.col("_rest")).cast("long")).drop("_before")
    whole = whole.unionByName(more)
    both = whole.unionByName(last).withColumn("domain", F.col(names[0]))
    return both.drop(*names, "_full", "_rest", "_order")


#: production parameters: share of all tokens to take, target weights of domains and languages, and the power by which sources are tempered
SHARE, POWER = 0.9, 0.7
TARGETS = {"domain": {"domain0": 0.5, "domain1": 0.15, "domain2": 0.2, "domain3": 0.15}, "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}}


def production() -> Weight:
    return stated(TARGETS, tempered(POWER))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture takes each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mixed(docs, SHARE, production()).select("doc_id", "domain", "lang", "source", "n_tokens", "n_copies")
