"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size.  The
documents of a source lie in size order; their expected copies are prefix-summed, one random
offset per source is added, and a document is emitted once for every integer boundary its
interval crosses.  In size order neighbouring documents stand in for each other, so the words
taken differ from the target by no more than about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0


def word_count(text: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, *, source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    ``sizes`` has a row per source (source, source_size, n_docs).  Sources in code-point order,
    null last, take the weights in turn and share the sum of all sizes; a target stops at
    ``max_epochs`` times its source's size and the excess is shared again by weight.  The level at
    which that ends is found directly: in ascending order of cap / weight, the first sources are
    at their caps and the rest get (total - caps) * weight / rest of the weights.  The windows run
    over one row per source.  A source without words has target 0.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("_w", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    share = F.greatest(left, F.lit(0.0)) * F.col("_w") / F.sum("_w").over(onward)
    # Once a source stays below its cap, the level it shows holds for all that follow.
    level = named.withColumn("_level", F.when(share <= F.col("_cap"), share / F.col("_w")))
    found = F.first("_level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_cap"), F.coalesce(found * F.col("_w"), F.col("_cap")))
    return level.withColumn("target", target).select(source, "source_size", "n_docs", "target")


def plan_copies(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 17,
    salts: int = 32,
    label: str = "mixing",
) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies.

    Repeated rows and equal keys are separate documents; ties rank by the key.  Null texts
    have size 0, null sources form one source.  A source of size 0 gets no copies.  The offset of
    a source is a hash of its name and ``seed``, so reruns agree.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, label)
    sized = scratch.table(docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), word_count(text).alias("_size")), "sizes")
    placed = _placed(sized, sized, scratch, weights, max_epochs, seed, salts)
    return placed.select(F.col("_k").alias(key), F.col("_s").alias(source), F.col("_size").alias("size"), "source_size", "target", "copies")


def _placed(rows: DataFrame, sized: DataFrame, scratch: Scratch, weights: tuple[float, ...], max_epochs: float, seed: int, salts: int) -> DataFrame:
    """``rows`` (with _k, _s and _size) and their source_size, target and copies, as ``sized``, the same rows, has it.

    Ranks within a source come from blocks (source, band of sizes, salt): a window inside each
    block and an offset per block, so no task holds a source and equal sizes spread over ``salts``
    blocks.
    """

    def blocked(df: DataFrame) -> DataFrame:
        band = F.floor(F.log2(F.col("_size") + 1) * 64).cast("int")
        df = df.withColumn("_none", F.col("_s").isNull()).withColumn("_name", F.coalesce("_s", F.lit("")))
        return df.withColumn("_band", band).withColumn("_salt", F.pmod(F.xxhash64("_k", F.lit(seed)), F.lit(salts)).cast("int"))

    src = F.col("_s")
    blocks = blocked(sized).groupBy("_s", "_band", "_salt").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    blocks = scratch.table(blocks, "blocks")
    bands = blocks.groupBy("_s", "_band").agg(F.sum("_n").alias("_band_n"), F.sum("_words").alias("_band_words"))
    upto = Window.partitionBy("_s").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_s", "_band").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = bands.withColumn("_start", F.coalesce(F.sum("_band_n").over(upto), zero)).select(src.alias("_s1"), F.col("_band").alias("_b"), "_start")
    sizes = bands.groupBy("_s").agg(F.sum("_band_words").alias("source_size"), F.sum("_band_n").alias("n_docs"))
    targets = source_targets(sizes, source="_s", weights=weights, max_epochs=max_epochs).withColumnRenamed("_s", "_s2")
    offsets = (
        blocks.withColumn("_within", F.coalesce(F.sum("_n").over(inside), zero))
        .join(starts, src.eqNullSafe(F.col("_s1")) & (F.col("_band") == F.col("_b")))
        .join(targets, src.eqNullSafe(F.col("_s2")))
        .select(src.isNull().alias("_o"), F.coalesce(src, F.lit("")).alias("_src"), F.col("_band").alias("_bd"), F.col("_salt").alias("_st"), (F.col("_start") + F.col("_within")).alias("_offset"), "source_size", "target")
    )
    offsets = scratch.table(offsets, "offsets")
    order = Window.partitionBy("_none", "_name", "_band", "_salt").orderBy("_size", "_k")
    ranked = blocked(rows).withColumn("_row", F.row_number().over(order))
    # The rows lie by block already: only the offsets, a row per block, are dealt out to them.
    same = (F.col("_none") == F.col("_o")) & (F.col("_name") == F.col("_src")) & (F.col("_band") == F.col("_bd")) & (F.col("_salt") == F.col("_st"))
    placed = ranked.join(offsets, same)
    # A dyadic offset keeps sums with whole expectations exact.
    start = F.pmod(F.xxhash64(F.coalesce(src, F.lit("\0null")), F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("_offset") + F.col("_row")
    copies = (F.floor(start + each * place) - F.floor(start + each * (place - 1))).cast("bigint")
    return placed.withColumn("copies", copies)


def mix(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 17, salts: int = 32, label: str = "mix"
) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as planned for that row, its columns in order.

    The rows themselves are ranked, so that rows that repeat a key, or have none, each keep their
    own number of copies.
    """
    scratch = Scratch(docs.sparkSession, label)
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_doc"), F.col(key).alias("_k"), F.col(source).alias("_s"), word_count(text).alias("_size"))
    sized = scratch.table(whole.drop("_doc"), "sizes")
    placed = _placed(whole, sized, scratch, weights, max_epochs, seed, salts).filter("copies > 0")
    return placed.select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).select("_doc.*")


def op9_mixing(docs: DataFrame) -> DataFrame:
    """Contract columns of the mix of all documents."""
    plan = plan_copies(docs)
    return plan.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")
