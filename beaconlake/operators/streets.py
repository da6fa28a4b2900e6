"""Names of streets as they were misheard, and where streets cross.

A misheard name and the name meant share a form that both reach by leaving letters out: those forms are
an index, and every pair within the edits allowed meets in it, whatever letter is wrong.  Segments of
streets meet in the cells of a grid that both pass through, and only those are intersected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import geo

# How much worse the next candidate must be, how near in score and place candidates are one answer, and what a name among a few may cost.
MARGIN, LOOSE_MARGIN = 1.5, 1.4
POOL, POOL_M = 1.35, 700.0
FEW, ONLY = 0.85, 0.7


def left_out(word: Column, cap: int) -> Column:
    """The word and all that is left of it without up to ``cap`` of its letters."""

    def one_less(w: Column) -> Column:
        return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array(F.lit("")))

    forms = last = F.array(word)
    for _ in range(cap):
        last = F.array_distinct(F.flatten(F.transform(last, one_less)))
        forms = F.concat(forms, last)
    return F.array_distinct(forms)


def near_names(heard: DataFrame, names: DataFrame, by: list[str], cap: int) -> DataFrame:
    """(``by``, core, name, edits) of every heard core and every name of the same ``by`` whose core is within ``cap`` edits.

    ``heard``: by, core; ``names``: by, name, core.  None is missed: what ``cap`` edits part, ``cap``
    letters left out of either make equal.
    """
    h = heard.select(*by, "core").distinct().select(*by, "core", F.explode(left_out(F.col("core"), cap)).alias("_form"))
    n = names.select(*[F.col(c).alias(f"_{c}") for c in by], "name", F.col("core").alias("_core"), F.explode(left_out(F.col("core"), cap)).alias("_same"))
    same = F.col("_form") == F.col("_same")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    met = h.join(n, same).select(*by, "core", "name", "_core").distinct()
    return met.withColumn("edits", F.levenshtein("core", "_core", cap)).filter("edits >= 0").drop("_core")


def skeleton(core: Column) -> Column:
    """The first letter and the consonants after it."""
    return F.concat(F.substring(core, 1, 1), F.regexp_replace(F.substr(core, F.lit(2)), "[aeiouy]", ""))


def corrected(heard: DataFrame, known: DataFrame, cap: int = 2) -> DataFrame:
    """(town, core, type, meant, lat, lon, sure) for names heard that are no street's, where an answer stands out.

    A candidate costs its edits by length, half its edits of the skeleton, and 0.3 for another type of
    street.  The best is meant if the next costs MARGIN times as much, or if it is close by itself LOOSE_MARGIN
    times; else, if all that cost little more lie within POOL_M of it, their middle is, without a name.
    """
    h = heard.select("town", "core", "type").distinct()
    pairs = near_names(h, known, ["town"], cap).filter("edits > 0")
    k = known.select(F.col("town").alias("_t"), F.col("name").alias("_n"), F.col("core").alias("_core"), F.col("type").alias("_type"), "lat", "lon")
    met = pairs.join(k, (F.col("town") == F.col("_t")) & (F.col("name") == F.col("_n"))).drop("_t", "_n")
    met = h.join(met.withColumnsRenamed({"town": "_t", "core": "_c"}), (F.col("town") == F.col("_t")) & (F.col("core") == F.col("_c")))
    bones = F.levenshtein(skeleton(F.col("core")), skeleton(F.col("_core")))
    score = F.col("edits") / F.greatest(F.length("core"), F.length("_core")) + 0.5 * bones / F.greatest(F.lit(1), F.length(skeleton(F.col("_core")))) + F.when(F.col("type") == F.col("_type"), 0.0).otherwise(0.3)
    w = Window.partitionBy("town", "core", "type")
    ranked = met.withColumns({"score": F.round(score, 6), "_bones": bones}).withColumns({"_r": F.row_number().over(w.orderBy("score", "name")), "_next": F.lead("score").over(w.orderBy("score", "name"))})
    best = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c))).over(w)
    ranked = ranked.withColumns({"_best": best("score"), "_blat": best("lat"), "_blon": best("lon")})
    pool = F.col("score") <= F.col("_best") * POOL
    near = geo.metres(F.col("_blat"), F.col("_blon"), F.col("lat"), F.col("lon")) <= POOL_M
    groups = ranked.groupBy("town", "core", "type").agg(
        F.max_by(F.struct("name", "lat", "lon", "score", "_next", "_bones"), -F.col("_r")).alias("b"), F.count_if(pool).alias("_pool"), F.bool_and(near | ~pool).alias("_together"),
        F.avg(F.when(pool, F.col("lat"))).alias("_lat"), F.avg(F.when(pool, F.col("lon"))).alias("_lon"),
    )
    margin = lambda m: F.col("b._next").isNull() | (F.col("b._next") >= F.col("b.score") * m)
    sure = margin(MARGIN) | (margin(LOOSE_MARGIN) & (F.col("b._bones") <= 1))
    found = groups.withColumn("sure", sure).filter(F.col("sure") | ((F.col("_pool") > 1) & F.col("_together")))
    return found.select("town", "core", "type", F.when(F.col("sure"), F.col("b.name")).alias("meant"), F.when(F.col("sure"), F.col("b.lat")).otherwise(F.col("_lat")).alias("lat"), F.when(F.col("sure"), F.col("b.lon")).otherwise(F.col("_lon")).alias("lon"), "sure")


def crossings(segments: DataFrame, by: str = "town", cell: float = 0.02) -> DataFrame:
    """(``by``, a, b, lat, lon) where segments of two streets a < b of the same ``by`` meet; the least point if they do more than once.

    ``segments``: by, name, lat, lon, lat2, lon2.  A segment is in the cells of its bounding box
    that it passes; parallel segments do not cross.
    """
    grid = lambda c: F.floor(c / cell).cast("bigint")
    rows = F.sequence(grid(F.least("lat", "lat2")), grid(F.greatest("lat", "lat2")))
    s = segments.select(by, "name", "lat", "lon", "lat2", "lon2", F.explode(rows).alias("_i"))
    # In a row of cells a segment covers the columns between where it enters and leaves the row.
    flat = F.col("lat") == F.col("lat2")
    at = lambda y: F.when(flat, F.col("lon")).otherwise(F.col("lon") + (F.col("lon2") - F.col("lon")) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - F.col("lat")) / (F.col("lat2") - F.col("lat")))))
    enter, leave = at(F.col("_i") * cell), F.when(flat, F.col("lon2")).otherwise(at((F.col("_i") + 1) * cell))
    s = s.withColumn("_j", F.explode(F.sequence(grid(F.least(enter, leave) - 1e-9), grid(F.greatest(enter, leave) + 1e-9))))
    a, b = s.alias("a"), s.alias("b")
    met = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")) & (F.col("a.name") < F.col("b.name")))
    d = lambda t, c: F.col(f"{t}.{c}2") - F.col(f"{t}.{c}")
    across = d("a", "lat") * d("b", "lon") - d("a", "lon") * d("b", "lat")
    gap_lat, gap_lon = F.col("b.lat") - F.col("a.lat"), F.col("b.lon") - F.col("a.lon")
    on_a, on_b = (gap_lat * d("b", "lon") - gap_lon * d("b", "lat")) / across, (gap_lat * d("a", "lon") - gap_lon * d("a", "lat")) / across
    hit = met.filter((across != 0) & on_a.between(0, 1) & on_b.between(0, 1))
    point = F.struct((F.col("a.lat") + on_a * d("a", "lat")).alias("lat"), (F.col("a.lon") + on_a * d("a", "lon")).alias("lon"))
    return hit.select(F.col(f"a.{by}").alias(by), F.col("a.name").alias("a"), F.col("b.name").alias("b"), point.alias("p")).groupBy(by, "a", "b").agg(F.min("p").alias("p")).select(by, "a", "b", "p.lat", "p.lon")


def both_ways(crossed: DataFrame, by: str = "town") -> DataFrame:
    """Crossings by either of their streets: (by, street, other, lat, lon)."""
    one = crossed.select(by, F.col("a").alias("street"), F.col("b").alias("other"), "lat", "lon")
    return one.unionByName(crossed.select(by, F.col("b").alias("street"), F.col("a").alias("other"), "lat", "lon"))


def best_of(asked: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, name) of the name among the few of each key that is most like the core heard: edits by length and 0.8 of those of the skeleton, FEW at most, ONLY if there is one name.

    ``asked``: key, heard; ``names``: key, name, core.  Cores of fewer than four letters match only their like.
    """
    k = names.select(*[F.col(c).alias(f"_{c}") for c in key], "name", F.col("core").alias("_core"))
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"_{c}"))
    met = asked.select(*key, "heard").distinct().join(k, same)
    cost = F.levenshtein("heard", "_core") / F.greatest(F.length("heard"), F.length("_core")) + 0.8 * F.levenshtein(skeleton(F.col("heard")), skeleton(F.col("_core"))) / F.greatest(F.lit(1), F.length(skeleton(F.col("heard"))))
    w = Window.partitionBy(*key, "heard")
    scored = met.withColumns({"_cost": F.round(cost, 6), "_few": F.count("*").over(w)}).withColumn("_r", F.row_number().over(w.orderBy("_cost", "name")))
    fits = (F.col("_cost") == 0) | ((F.length("heard") >= 4) & (F.col("_cost") <= F.when(F.col("_few") > 1, FEW).otherwise(ONLY)))
    return scored.filter((F.col("_r") == 1) & fits).select(*key, "heard", "name")
