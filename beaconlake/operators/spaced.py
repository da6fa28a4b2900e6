"""Rows that a picker keeps who takes the first and then each that is at least so long after the last taken.

What is kept depends on all that was kept before, so it is found as a scan of functions: a chunk of
time is the function that maps the last time kept before it to the last kept in it.  That function
steps only at the few times near the chunk's begin, chunks compose to longer ones, and once every
chunk knows what was kept before, all pick at once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks that one task composes.
FAN = 64
_STEPS = "entries array<bigint>, exits array<bigint>"


def _last_kept(times: np.ndarray, floor: int) -> np.ndarray:
    """For each time the last one kept if picking begins with it."""
    after = np.searchsorted(times, times + floor)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            last[i] = last[after[i]]
    return times[last]


def _apply(entries, exits, last: int | None, floor: int) -> int | None:
    """The last time kept after a chunk, from the one before it."""
    at = 0 if last is None else bisect_left(entries, last + floor)
    return exits[at] if at < len(entries) else last


def _compose(steps: list[tuple[list[int], list[int]]], floor: int) -> tuple[list[int], list[int]]:
    """The function of chunks in a row: it steps where the first does, and at the second's first time."""
    first, rest = steps[0], steps[1:]
    begins = [(e, x, rest) for e, x in zip(*first)]
    if rest:
        begins.append((rest[0][0][0], rest[0][1][0], rest[1:]))
    entries, exits = [], []
    for entry, last, chunks in begins:
        for chunk in chunks:
            last = _apply(*chunk, last, floor)
        entries.append(entry)
        exits.append(last)
    return entries, exits


def spaced(rows: DataFrame, keys: list[str], at: str, floor: int, chunk: int | None = None) -> DataFrame:
    """The different (keys, ``at``) that are kept, by key: the least ``at``, then each at least ``floor`` after the last kept.

    ``at`` is a bigint; nulls are never kept, null keys are a key.  ``chunk`` is the length of a
    chunk, ``floor`` at least; a task holds the different times of one chunk or FAN functions.
    """
    chunk = max(floor, chunk or floor)
    few = rows.select(*keys, F.col(at).cast("bigint").alias("at")).filter("at IS NOT NULL").distinct()
    ends = few.agg(F.min(F.floor(F.col("at") / chunk)), F.max(F.floor(F.col("at") / chunk))).first()
    base, chunks = (ends[0] or 0), (ends[1] or 0) - (ends[0] or 0) + 1
    timed = few.withColumn("c0", F.floor(F.col("at") / chunk) - base)
    by = ", ".join(f"`{k}` {few.schema[k].dataType.simpleString()}" for k in keys)
    by = f"{by}, " if by else ""

    def stepped(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["at"].to_numpy())
        n = int(np.searchsorted(times, (int(pdf.c0.iloc[0]) + base) * chunk + floor)) + 1
        return _one(pdf, ["c0"], entries=times[:n].tolist(), exits=_last_kept(times, floor)[:n].tolist())

    def _one(pdf: pd.DataFrame, also: list[str], **values) -> pd.DataFrame:
        out = pdf[[*keys, *also]].iloc[:1].reset_index(drop=True)
        for name, value in values.items():
            out[name] = pd.Series([value], dtype=object)
        return out

    def composer(k: int):
        def composed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(f"c{k - 1}")
            entries, exits = _compose([(list(e), list(x)) for e, x in zip(pdf.entries, pdf.exits)], floor)
            return _one(pdf, [f"c{k}"], entries=entries, exits=exits)

        return composed

    def hander(k: int):
        def handed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(f"c{k - 1}")
            last, told = None if pd.isna(pdf.before.iloc[0]) else int(pdf.before.iloc[0]), []
            for e, x in zip(pdf.entries, pdf.exits):
                told.append(last)
                last = _apply(list(e), list(x), last, floor)
            return pdf[[*keys, f"c{k - 1}"]].assign(before=pd.array(told, dtype="Int64"))

        return handed

    grouped = lambda df, k: df.withColumn(f"c{k}", F.floor(F.col(f"c{k - 1}") / FAN))
    levels = [timed.groupBy(*keys, "c0").applyInPandas(stepped, f"{by}c0 bigint, {_STEPS}")]
    while chunks > 1:
        k, chunks = len(levels), -(-chunks // FAN)
        levels.append(grouped(levels[-1], k).groupBy(*keys, f"c{k}").applyInPandas(composer(k), f"{by}c{k} bigint, {_STEPS}"))
    before = levels[-1].select(*keys, f"c{len(levels) - 1}", F.lit(None).cast("bigint").alias("before"))
    for k in range(len(levels) - 1, 0, -1):
        known = _joined(grouped(levels[k - 1], k), before, [*keys, f"c{k}"])
        before = known.groupBy(*keys, f"c{k}").applyInPandas(hander(k), f"{by}c{k - 1} bigint, before bigint")

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["at"].to_numpy())
        place = 0 if pd.isna(pdf.before.iloc[0]) else int(np.searchsorted(times, int(pdf.before.iloc[0]) + floor))
        kept = []
        while place < len(times):
            kept.append(int(times[place]))
            place = int(np.searchsorted(times, times[place] + floor))
        out = pdf[[*keys, "at"]].iloc[[0] * len(kept)].reset_index(drop=True)
        out["at"] = np.array(kept, dtype=np.int64)
        return out

    found = _joined(timed, before, [*keys, "c0"]).groupBy(*keys, "c0").applyInPandas(picked, f"{by}at bigint")
    return found.withColumnRenamed("at", at)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on columns of which nulls are equal; the right's copies go."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in right.columns if c not in on])
    same: Column = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, same).drop(*[f"_{c}" for c in on])
