"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies follow from its source's target and, mildly, from its length. The whole part of the
expectation is given for certain; its fraction p is an inclusion probability. Documents are ranked by the odds of
a uniform number divided by the odds of p, and the head of the ranking is taken: a sample of fixed size, measured
in words. The head's end is found by counting words in cells of the ranking, twice, so that no task ever sorts a
whole source; only the last cell's few documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasift.llm.common import count_words, stored

#: Cells of the ranking: the logarithm of the odds ratio lies within +-LIMIT; coarse cells are 1/32 wide, fine ones 1/65536.
LIMIT, COARSE, FINE = 128, 32, 65536


def weight_of(rank: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target, and the constants of its documents' expected copies.

    Each source gets its weight's part of share * all words. A source never gets over `most` times its own
    words: the excess goes to the others by weight until none is above (water filling: the others get
    level * weight). Sums are integers, so reruns agree to the bit. One row a source.
    """
    by = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") * F.col("root")).cast("decimal(38,0)")).alias("root_size"),
        F.max("root").alias("most_root"),
    )
    ranked = by.withColumn("w", weight_of(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, weights).cast("double"))
    cap = F.col("source_size") * most
    # In order of cap / weight, the first sources are the ones that stop at their cap.
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    filled = (
        ranked.withColumn("cap", cap.cast("double"))
        .withColumn("total", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest_w"))
        .withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
        # The first source that fits sets the level; those after it fit at lower ones.
        .withColumn("level", F.max("fits").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    )
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    top = F.try_divide(F.col("most_root") * F.col("source_size"), F.col("root_size").cast("double"))
    # The part of the expectation that follows the length: as much as keeps the longest document within `most`.
    lean = F.when((F.col("source_size") > 0) & (top > 1) & (F.col("rate") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(most / F.col("rate") - 1, top - 1)))).otherwise(0.0)
    return filled.withColumn("rate", r).withColumn("lean", lean).select("source", "source_size", "target", "rate", "lean", F.try_divide(F.col("source_size"), F.col("root_size").cast("double")).alias("per_root"))


def uniform(seed: str) -> Column:
    """A number in (0, 1) from the id and size: 52 bits of MD5."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def allocated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row of docs (needs doc_id, source, text).

    Null texts and texts without words have size 0; they get the copies that the ranking gives them, and take no
    words. A null source is a source of its own, last in order. Ties in the ranking go by id, repeated rows are
    documents of their own and take turns. Reruns agree. A source's taken words differ from its target by half of
    one document at most.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words(F.col("text")).alias("size")).withColumn("root", F.floor(F.sqrt(F.col("size").cast("double")) * 1024))
    sized = stored(sized, "sizes")
    goal = stored(targets(sized, weights, share, most), "targets")
    g = goal.withColumnRenamed("source", "__source")
    u = uniform(seed)
    expected = F.least(F.lit(float(most)), F.col("rate") * (1 - F.col("lean") + F.col("lean") * F.col("root") * F.coalesce("per_root", F.lit(0.0))))
    rows = (
        sized.join(g, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("v", F.when(F.col("p") > 0, F.log(u / (1 - u)) - F.log(F.col("p") / (1 - F.col("p")))))
        # greatest and least skip nulls, which stay: a document without a fraction isn't ranked.
        .withColumn("v", F.when(F.col("v").isNotNull(), F.greatest(F.lit(-LIMIT + 1.0), F.least(F.lit(LIMIT - 1.0), F.col("v")))))
        .withColumn("coarse", F.floor((F.col("v") + LIMIT) * COARSE))
        .withColumn("fine", F.floor((F.col("v") + LIMIT) * FINE))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "v", "coarse", "fine")
    )
    whole_words = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    left = goal.join(whole_words.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select("source", (F.col("target") - F.col("sure")).alias("left"))
    left = stored(left, "left")

    def end(cells: DataFrame, left: DataFrame, cell: str) -> DataFrame:
        """source, the cell in which its words are used up, and the words left for that cell."""
        c = cells.groupBy("source", cell).agg(F.sum("size").alias("words"))
        c = c.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        l = left.withColumnsRenamed({"source": "__l", "left": "__left"})
        c = c.join(l, F.col("source").eqNullSafe(F.col("__l")))
        return c.where(F.col("before") <= F.col("__left")).groupBy("source").agg(F.max(cell).alias("cell"), F.max_by(F.col("__left") - F.col("before"), F.col(cell)).alias("left"))

    ranked = rows.where(F.col("v").isNotNull())
    first = stored(end(ranked, left, "coarse"), "coarse")
    f = first.withColumnsRenamed({"source": "__f", "cell": "coarse_end"})
    within = ranked.join(f.drop("left"), F.col("source").eqNullSafe(F.col("__f")) & (F.col("coarse") == F.col("coarse_end")))
    second = stored(end(within, first, "fine"), "fine")
    e = second.withColumnsRenamed({"source": "__e", "cell": "fine_end", "left": "__left"})
    rows = rows.join(e, F.col("source").eqNullSafe(F.col("__e")), "left")
    last = F.coalesce(F.col("fine") == F.col("fine_end"), F.lit(False))
    inside = rows.where(last)
    order = W.partitionBy("source").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("used", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("more", (F.col("used") + F.col("size") / 2 <= F.col("__left")).cast("long")).drop("used")
    outside = rows.where(~last).withColumn("more", F.coalesce(F.col("fine") < F.col("fine_end"), F.lit(False)).cast("long"))
    copies = F.col("whole") + F.col("more")
    return outside.unionByName(inside).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, or up to `most` times); columns unchanged.

    Rows that agree in doc_id, source and size share their copies' rank, so they are matched by an own number.
    """
    rows = docs.withColumn("__size", count_words(F.col("text")))
    got = allocated(docs, **options)
    # Equal (doc_id, source, size) may differ in text only where ids repeat: their copies are dealt out in order.
    key = ["doc_id", "source", "size"]
    got = got.groupBy(*key).agg(F.array_sort(F.collect_list("copies")).alias("__copies")).withColumnsRenamed({k: f"__k_{k}" for k in key})
    nth = W.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64("text"))
    rows = rows.withColumn("__nth", F.row_number().over(nth))
    match = F.col("doc_id").eqNullSafe(F.col("__k_doc_id")) & F.col("source").eqNullSafe(F.col("__k_source")) & (F.col("__size") == F.col("__k_size"))
    out = rows.join(got, match).withColumn("__c", F.element_at("__copies", F.col("__nth"))).where(F.col("__c") > 0)
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
