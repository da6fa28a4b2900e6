"""Sharding by sampled splitters, with DataFrame functions only.

A sample of keys, weighted by record size, gives quantile splitters that cut the key space
into many fine ranges.  One exact pass weighs the ranges.  A range stays whole unless it outweighs
a whole shard; only then it is subdivided by record.  Heavy ranges take the lightest shards, the
rest fill the shards, in key order, to equal sizes; records of one range move together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.scratch import unused

FINE_PER_SHARD = 64
SAMPLES_PER_FINE = 16
#: A range over this part of a shard is placed before the others.
HEAVY = 1 / 16
_UNIT = float(1 << 52)


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the values only, so that a lost task draws the same sample."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12) / F.lit(_UNIT)


def splitters(records: DataFrame, n_ranges: int, *, key: str, size: str, tie: str, total: int, seed: int = 11) -> list[int]:
    """At most ``n_ranges - 1`` ascending splitters at the size-weighted quantiles of ``key`` (a bigint column).

    Each record enters the sample about size / total * n_ranges * SAMPLES_PER_FINE times.  Only the
    quantiles, a number of values bounded by ``n_ranges``, come to the driver.
    """
    expected = F.col(size) * (n_ranges * SAMPLES_PER_FINE / max(total, 1))
    drawn = F.floor(expected + _uniform(F.col(key), F.col(tie), F.lit(seed))).cast("int")
    sample = records.select(F.col(key), drawn.alias("_drawn")).filter("_drawn > 0")
    copies = F.explode(F.array_repeat(F.col(key), F.col("_drawn")))
    steps = F.expr(f"array({', '.join(f'{i}D / {n_ranges}D' for i in range(1, n_ranges))})")
    row = sample.select(copies.alias("_k")).agg(F.percentile_approx("_k", steps, 20 * n_ranges).alias("q")).first()
    return sorted(set(row.q or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of splitters at or below ``key``: a binary search over an array literal."""
    if not bounds:
        return F.lit(0)
    table = F.expr(f"from_json('{bounds}', 'array<bigint>')")
    steps = len(bounds).bit_length()
    width = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    n = len(bounds)

    def step(found: Column, w: Column) -> Column:
        to = found + w
        return F.when((to <= n) & (F.get(table, to - 1) <= key), to).otherwise(found)

    return F.aggregate(width, F.lit(0), step)


def assign_shards(
    records: DataFrame,
    n_shards: int,
    *,
    key: str,
    size: str,
    tie: str,
    fine_per_shard: int = FINE_PER_SHARD,
) -> DataFrame:
    """``records`` with two more columns: shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    A column of those names is replaced.  ``key`` is a non-null bigint column, ``size`` a bigint
    weight, ``tie`` an orderable column that tells records of one key apart (nulls first; rows
    equal in both are interchangeable and stay together).  Records of one key share a shard unless
    their range outweighs a shard; it is then subdivided by a hash of ``tie``.  Apart from ranges
    over HEAVY of a shard, shards are contiguous along ``key``.  An empty table returns no rows.
    The driver holds one number per fine range, a count fixed by the parameters.
    """
    range_, piece, row, first = unused(records, "_range", "_piece", "_row", "_first")
    kept = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    n_fine = n_shards * fine_per_shard
    total = records.agg(F.sum(size)).first()[0] or 0
    bounds = splitters(records, n_fine, key=key, size=size, tie=tie, total=total)
    ranged = records.withColumn(range_, range_of(F.col(key), bounds))
    weights = {r[0]: r[1] for r in ranged.groupBy(range_).agg(F.sum(size)).collect()}
    fair = max(total / n_shards, 1.0)
    parts = {r: min(n_fine, math.ceil(w * fine_per_shard / fair)) for r, w in weights.items() if w > fair}
    split = F.lit(0)
    if parts:
        pieces = F.create_map(*[F.lit(x) for r, p in sorted(parts.items()) for x in (r, p)])
        split = F.pmod(F.xxhash64(F.col(tie), F.col(size), F.lit(5)), F.coalesce(pieces[F.col(range_)], F.lit(1))).cast("int")
    fine = ranged.withColumn(piece, split)
    measured = sorted(fine.groupBy(range_, piece).agg(F.sum(size).alias("w"), F.count("*").alias("n")).collect())
    shard_of = _filled([m.w for m in measured], n_shards, fair)
    rows, next_slot = [], [0] * n_shards
    for m, shard in zip(measured, shard_of):
        rows.append((m[0], m[1], shard, next_slot[shard]))
        next_slot[shard] += m.n
    table = records.sparkSession.createDataFrame(rows, f"{range_} int, {piece} int, shard int, {first} bigint")
    numbered = fine.select(*kept, range_, piece, F.row_number().over(Window.partitionBy(range_, piece).orderBy(key, tie)).alias(row))
    placed = numbered.join(F.broadcast(table), [range_, piece])  # at most 2 * n_fine rows
    return placed.select(*kept, "shard", (F.col(first) + F.col(row) - 1).cast("bigint").alias("slot"))


def _filled(weights: list[int], n_shards: int, fair: float) -> list[int]:
    """Shard of each range: heavy ones, the heaviest first, go to the lightest shard, the others in order to where there is room."""
    held = [0.0] * n_shards
    shard_of = [0] * len(weights)
    heavy = {i for i, w in enumerate(weights) if w > HEAVY * fair}
    for i in sorted(heavy, key=lambda i: (-weights[i], i)):
        shard_of[i] = held.index(min(held))
        held[shard_of[i]] += weights[i]
    at = 0
    # What the heavy ranges leave of each shard, up to a level that just takes in the light ones.
    light = sum(w for i, w in enumerate(weights) if i not in heavy)
    level = _level(held, light)
    room = [max(0.0, level - h) for h in held]
    filled, upto = 0.0, room[0] if room else 0.0
    for i, w in enumerate(weights):
        if i not in heavy:
            while at < n_shards - 1 and filled + w / 2 > upto:
                at += 1
                upto += room[at]
            shard_of[i] = at
            filled += w
    return shard_of


def _level(held: list[float], more: float) -> float:
    """The level to which ``more`` fills shards that already hold ``held``, the emptiest first."""
    ordered = sorted(held)
    below = 0.0
    for k, h in enumerate(ordered, 1):
        below += h
        level = (below + more) / k
        if k == len(ordered) or level <= ordered[k]:
            return level
    return 0.0


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Assign shards and write them as Parquet, one folder ``shard=N`` each, rows in slot order."""
    placed = assign_shards(records, **options)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op8_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Contract columns: all documents in 40 shards of nearly equal bytes; equal texts share a shard unless they outweigh one.

    Only a checksum and the size of a text go through the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.xxhash64(text).alias("range_key"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign_shards(records, n_shards, key="range_key", size="size", tie="doc_id")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
