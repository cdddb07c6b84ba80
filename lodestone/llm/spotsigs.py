"""Document fingerprints by spot signatures, with DataFrame and SQL functions only.

A signature is an anchor (a very common word of one of the languages) with the
chain of the next content words; words that are anchors themselves are skipped
inside a chain. Words are runs of letters, marks and digits in any case, so marks
around them do not count. A document's fingerprint is its set of signatures.
Likeness is the Jaccard coefficient of two sets.

Edge cases: a null text counts as empty; a text without any chain has the set of
its word shingles for signatures (pieces between blanks stand for words where
there is none, an empty text has one signature), so that equal texts always have
equal fingerprints and near copies without anchors stay alike; repeated rows are
fingerprinted row by row; extra columns pass through untouched unless a name
clashes with a column made here, which then replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the of and to in a is that for it was on be with as by this are at an from or "
    "le la les de des du un une et en est que qui pour dans par sur au aux pas "
    "der die das und ist von den mit zu dem ein eine nicht auf für im als sich "
    "el los las del y una por con para se no lo su al es"
).split()


# letters, marks and digits make words; all else stands around them
OTHER = r"[^\p{L}\p{M}\p{N}]++"
# scripts without blanks between words: each character counts as a word in a text without chains
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
SHINGLE = 3


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, factored by common first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[:1], []).append(w[1:])
    parts = [c + (any_of(rest) if rest != [""] else "") for c, rest in sorted(by.items()) if c]
    return "(?:" + "|".join(parts) + ")" + ("?+" if "" in by else "") if parts else ""


def content_pattern(anchors: list[str] = ANCHORS) -> str:
    """Java pattern whose group 1 is a content word with all anchors right before it.

    It is for lower-cased words joined by single blanks, each with a blank on either
    side. All quantifiers are possessive and matches do not overlap, so the scan is linear.
    """
    return rf" ((?:{any_of(anchors)} )*+[^ ]++)(?= )"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once: the lambda binds it."""
    return F.transform(F.array(value), f).getItem(0)


def chains(words: Column, chain: int) -> Column:
    """Hashes of each anchor with the next ``chain`` content words (fewer where the text ends)."""

    def of_all(parts: Column) -> Column:
        def of_one(part: Column, at: Column) -> Column:
            later = [F.substring_index(F.get(parts, at + k), " ", -1) for k in range(1, chain)]
            each = lambda own: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda a: F.xxhash64(F.concat_ws(" ", a, F.element_at(own, -1), *later)))
            return F.when(F.instr(part, " ") > 0, bound(F.split(part, " "), each)).otherwise(F.array().cast("array<bigint>"))

        return F.flatten(F.transform(parts, of_one))

    return bound(F.regexp_extract_all(words, F.lit(content_pattern()), F.lit(1)), of_all)


def shingled(text: Column, low: Column) -> Column:
    """Hashes of every ``SHINGLE`` words in a row (all if fewer); of pieces between blanks if there is no word."""
    words = F.regexp_extract_all(low, F.lit(rf"{UNSPACED}|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED[1:-1]}]]++"), F.lit(0))
    pieces = F.filter(F.split(text, r"[ \t\n\x0B\f\r]++"), lambda p: p != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda k: F.xxhash64(F.lit("words"), F.array_join(F.slice(w, k, F.lit(SHINGLE)), " ")))
    return bound(words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(bound(pieces, of)))


def signatures(text: Column, chain: int = 2) -> Column:
    """Sorted array of the distinct 64-bit signatures of a text; never empty or null."""
    whole = F.coalesce(text, F.lit(""))

    def of(low: Column) -> Column:
        found = chains(F.concat(F.lit(" "), F.regexp_replace(low, OTHER, " "), F.lit(" ")), chain)
        return bound(found, lambda s: F.when(F.size(s) > 0, s).otherwise(shingled(whole, low)))

    return F.sort_array(F.array_distinct(bound(F.lower(whole), of)))


def fingerprint(sigs: Column) -> Column:
    """The set as one string: signatures in order, comma-joined."""
    return F.array_join(sigs.cast("array<string>"), ",")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets.

    Pruned by size: where min(|a|,|b|)/max(|a|,|b|) < ``least`` no overlap can reach
    it, and the sets are not compared (0). With 0 every pair is compared.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    total = F.size(a) + F.size(b)
    full = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda s: s / (total - s)).getItem(0)
    return F.when(a == b, F.lit(1.0)).when(small < large * least, F.lit(0.0)).otherwise(full).cast("double")


def with_fingerprints(docs: DataFrame, text: str = "text", chain: int = 2) -> DataFrame:
    """Add signatures array<bigint> and fingerprint string."""
    return docs.withColumn("signatures", signatures(F.col(text), chain)).withColumn("fingerprint", fingerprint(F.col("signatures")))


def near_pairs(docs: DataFrame, least: float = 0.8, chain: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links between distinct fingerprints whose likeness is at least ``least``.

    Equal fingerprints are one class (smallest id). Classes are partitioned by set
    length into bands whose bounds grow by 1/least: a partner is in the own or the
    next band. Within a band, candidates share a signature among the
    ``n - ceil(least*n) + 1`` rarest ones (document frequency first, then hash), so
    common passages do not make candidates. Returns id_a < id_b (class ids), likeness.
    """
    sigs = docs.select(F.col(doc_id).alias("id"), signatures(F.col(text), chain).alias("sigs"))
    classes = sigs.groupBy("sigs").agg(F.min("id").alias("id")).withColumn("n", F.size("sigs"))
    one = classes.select("id", "n", F.explode("sigs").alias("s"))
    df = one.groupBy("s").agg(F.count("*").alias("df"))
    order = one.join(df, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)))
    pre = order.withColumn("band", band).select("id", "n", "band", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("x")).select("id", "n", "band", F.col("x.s").alias("s"), F.col("x.df").alias("df")).filter("df > 1")
    left = pre.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = pre.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "band")
    pairs = left.join(right, ["s", "band"]).filter("a != b and na <= nb").filter(F.col("na") >= F.col("nb") * least - 1e-9)
    pairs = pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    a, b = classes.select(F.col("id").alias("id_a"), F.col("sigs").alias("sa")), classes.select(F.col("id").alias("id_b"), F.col("sigs").alias("sb"))
    scored = pairs.join(a, "id_a").join(b, "id_b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least))
    return scored.filter(F.col("likeness") >= least).select("id_a", "id_b", "likeness")


def block_of(key: Column, edges: list[int], step: int = 64) -> Column:
    """How many of the sorted edges lie below the key, found in two levels."""
    if not edges:
        return F.lit(0)
    rows = [edges[i : i + step] for i in range(0, len(edges), step)]
    below = lambda xs: F.size(F.filter(xs, lambda e: e < key))
    row = F.greatest(below(F.array(*[F.lit(r[0]) for r in rows])), F.lit(1))
    fine = F.get(F.array(*[F.array(*[F.lit(e) for e in r]) for r in rows]), row - 1)
    return (row - 1) * step + below(fine)


def with_next(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add signatures, next_text and next_signatures: the latter of the next row in descending id order.

    After the last row comes the first. Rows are dealt by id into ``blocks`` ranges
    from approximate quantiles of all ids, so that no range grows with anything but the
    input; every range also gets a copy of the one row that follows its last one. Only
    the block bounds (``blocks`` integers) reach the driver or are broadcast. Rows of
    equal id are ordered by text; a null id counts as the smallest.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id), F.lit(-(2**63)))
    marks = [i / blocks for i in range(1, blocks)]
    edges = docs.select(F.percentile_approx(key, marks, 20 * blocks).alias("q")).first()["q"] if marks else None
    dealt = docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("_key", key).withColumn("_block", block_of(key, sorted(set(edges or []))).cast("int"))
    tops = sorted((r["_block"], r["k"]) for r in dealt.groupBy("_block").agg(F.max("_key").alias("k")).collect())
    # what follows a block's last row is the first row of the next lower block that has rows
    follows = spark.createDataFrame([(k, tops[(i + 1) % len(tops)][0]) for i, (_, k) in enumerate(tops)], "_key bigint, _to int")
    first = dealt.join(F.broadcast(follows), "_key").groupBy("_to").agg(F.max(F.struct("_key", F.col(text).alias("t"))).alias("top"))
    extra = first.select(F.col("_to").alias("_block"), F.col("top._key").alias("_key"), F.col("top.t").alias(text), F.lit(True).alias("_border"))
    both = dealt.withColumn("_border", F.lit(False)).unionByName(extra, allowMissingColumns=True).repartition(F.col("_block"))
    both = both.withColumn("signatures", signatures(F.col(text)))
    order = Window.partitionBy("_block").orderBy("_border", F.col("_key").desc(), F.col(text).desc())
    out = both.withColumn("next_text", F.lead(text).over(order)).withColumn("next_signatures", F.lead("signatures").over(order))
    return out.filter(~F.col("_border")).drop("_border", "_key", "_block")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = with_next(docs, min(blocks, 4096))
    text = F.col("text")
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    out = out.select("doc_id", n.cast("long").alias("n_chars"), "signatures", "next_signatures", F.concat(F.substr(text, F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half)).alias("edited"))
    out = out.withColumn("edited_signatures", signatures(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
