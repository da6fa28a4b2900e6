"""Operators over ordered rows: bursts, last-n, thinning, budgets, legs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_bursts(df: DataFrame, by: str, at: str, gap: int, tie: str, out: str = "burst", chunk: int = 64) -> DataFrame:
    """Number the bursts of ``by`` from 1: a row joins its predecessor if at most ``gap`` later (inclusive).

    ``at`` is an integer.  Rows are marked in stretches of ``chunk`` gaps, so a source that never rests is many tasks; what a stretch
    begins with comes from one row for each.  Rows without a time are one burst before all others.
    """
    stretch = df.withColumn("_c", F.coalesce(F.floor(F.col(at) / (chunk * gap)), F.lit(-(1 << 62))))
    w = Window.partitionBy(by, "_c").orderBy(at, tie)
    inner = F.when(F.lag(at).over(w).isNull() | (F.col(at) - F.lag(at).over(w) <= gap), 0).otherwise(1)
    marked = stretch.withColumn("_inner", inner).withColumn("_upto", F.sum("_inner").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = stretch.withColumn("_inner", inner).groupBy(F.col(by).alias("_by"), F.col("_c").alias("_k")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_inner").alias("_starts"))
    line = Window.partitionBy("_by").orderBy("_k")
    opens = F.when(F.col("_first") - F.lag("_last").over(line) <= gap, 0).otherwise(1)
    known = ends.withColumn("_opens", opens).select("_by", "_k", (F.sum(F.col("_starts") + F.col("_opens")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_starts")).alias("_base"))
    joined = marked.join(known, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_c") == F.col("_k")))
    return joined.withColumn(out, F.col("_base") + F.col("_upto")).select(*df.columns, out)


def aged_bursts(df: DataFrame, by: str, at: str, gap: int, max_age: int, tie: str, out: str = "burst_start") -> DataFrame:
    """Bursts that also end ``max_age`` after they began: each row gets the time its burst began.

    Where a burst begins depends on where the last one did, so rows are folded in order, but only
    inside a run without a larger gap: runs, not sources, are the unit of work.
    """
    runs = gap_bursts(df, by, at, gap, tie, "_run")

    def fold(done: Column, time: Column) -> Column:
        new = time - done["began"] > max_age
        return F.struct(F.when(new, time).otherwise(done["began"]).alias("began"), F.when(new, F.concat(done["starts"], F.array(time))).otherwise(done["starts"]).alias("starts"))

    zero = F.struct(F.lit(-(1 << 62)).cast("bigint").alias("began"), F.array().cast("array<bigint>").alias("starts"))
    starts = runs.groupBy(by, "_run").agg(F.aggregate(F.array_sort(F.collect_set(at)), zero, fold)["starts"].alias("_s"))
    # Beginnings and rows make one ordered stream; a row belongs to the last beginning at or before it.
    marks = starts.select(by, "_run", F.explode("_s").alias("_start")).select(F.col(by).alias("_by"), F.col("_run").alias("_r"), F.col("_start").alias("_at"), F.lit(0).alias("_side"), F.col("_start").alias(out))
    rows = runs.select(F.col(by).alias("_by"), F.col("_run").alias("_r"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row"))
    w = Window.partitionBy("_by", "_r").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    stream = marks.unionByName(rows, allowMissingColumns=True).withColumn(out, F.last(out, ignorenulls=True).over(w))
    return stream.filter("_side = 1").select("_row.*", out)


def ranked(df: DataFrame, key: str, order: list[Column], out: str, buckets: int = 64, descending: bool = True) -> DataFrame:
    """Number all rows from 1 in a total ``order`` that begins with ``key``, without one task for all of them.

    ``buckets`` quantiles of the key, the only values that reach the driver, cut the rows into ranges;
    a range is numbered by itself, after all rows of the ranges before it.
    """
    steps = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.agg(F.percentile_approx(key, steps, 10_000).alias("q")).first().q or []))
    above = F.lit(0)
    for c in cuts:
        above = above + F.coalesce((F.col(key) > F.lit(c)).cast("int"), F.lit(0))
    rows = df.withColumn("_range", -above if descending else above)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = rows.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = rows.withColumn("_inside", inside).join(F.broadcast(offsets), F.col("_range") == F.col("_r"))  # at most ``buckets`` rows
    return placed.withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_r", "_n", "_before", "_inside")


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group, with ``back`` = 1 for the newest."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def context_lines(df: DataFrame, by: str, order: list[str], value: str, n: int, out: str = "context") -> DataFrame:
    """The ``n`` values before each row of its group, oldest first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(out, F.collect_list(value).over(w))


def thin_tail(df: DataFrame, cap: int, share: float, at: str, tie: str) -> DataFrame:
    """At most ``cap`` rows: the newest ``share`` of the cap whole, the older rows evenly strided."""
    placed = ranked(df, at, [F.desc(at), F.desc(tie)], "_i")
    counted = placed.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    tail = max(1, min(cap - 1, int(cap * share)))
    head = cap - tail
    # Row j of the rest is picked if some i < head has floor(i * (n - tail) / head) = j.
    j, rest = F.col("_i") - 1 - tail, F.col("_n") - tail
    first = F.ceil(j * head / rest)
    picked = (first < head) & (F.floor(first * rest / F.lit(float(head))) == j)
    keep = (F.col("_n") <= cap) | (F.col("_i") <= tail) | picked
    return counted.filter(keep).drop("_i", "_n")


def two_bands(df: DataFrame, score: str, at: str, tie: str, near: float = 0.7) -> DataFrame:
    """Rank rows: those within ``near`` of the best score newest first, then the rest by score."""
    scored = df.filter(F.col(score) > 0)
    rows = scored.crossJoin(F.broadcast(scored.agg(F.max(score).alias("_best")))).withColumn("close", F.col(score) >= F.col("_best") * near).drop("_best")  # one row
    first = ranked(rows.filter("close"), at, [F.desc(at), F.col(tie)], "place")
    rest = ranked(rows.filter("NOT close"), score, [F.desc(score), F.desc(at), F.col(tie)], "_p")
    count = rows.agg(F.count_if("close").alias("_c"))
    return first.unionByName(rest.crossJoin(F.broadcast(count)).withColumn("place", F.col("_p") + F.col("_c")).drop("_p", "_c"))  # one row


def running_pack(df: DataFrame, by: list[str], size: str, order: list[Column], budget: int) -> DataFrame:
    """The rows of each group, in order, whose running total of ``size`` stays within ``budget``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def legs(df: DataFrame, by: str, order: list[str], cut: Column, out: str = "leg") -> DataFrame:
    """Split each trail where ``cut`` holds; legs of one row are dropped."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn(out, F.sum(cut.cast("int")).over(w))
    return numbered.withColumn("_n", F.count("*").over(Window.partitionBy(by, out))).filter("_n > 1").drop("_n")


def highest_so_far(df: DataFrame, by: str, order: list[str], value: str, rank: str, out: str) -> DataFrame:
    """The value of highest rank seen so far in the group (the earliest on ties)."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_p", place).withColumn(out, F.max(F.struct(F.col(rank), -F.col("_p"), F.col(value))).over(w)[value]).drop("_p")


def ordered_rank(df: DataFrame, order: Iterable[Column], out: str = "place") -> DataFrame:
    """Total order of a small result (a board)."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))
