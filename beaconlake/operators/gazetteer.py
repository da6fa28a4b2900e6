"""Places that a text names, by one pass of an automaton over its words.

All names are one automaton, built once per Python worker from a list that is broadcast if it has at most
MOST_NAMES entries; beyond that the runs of words of each text are joined with the names.  Which of
the names found is meant is decided in columns, the same for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import text as tx

MOST_NAMES = 200_000
MOST_WORDS = 6
# Words of our own that make a name something else than a place.
STREET_TYPES = ("street", "road", "avenue", "lane", "square", "drive")
RAIL_CUES = ("train", "platform", "inbound", "outbound", "station", "line")
ROAD_CUES = ("route", "highway", "interstate")
DIRECTIONS = ("north", "south", "east", "west", "bound")
#: A name in scope, a name that is no town, and what is good enough not to look for shorter names.
SCOPED, NAMED, ENOUGH = 100, 40, 140

_FOUND = "array<struct<at:int,n:int,alias:string>>"
_built: dict[int, object] = {}


def _automaton(names):
    """The automaton of a broadcast list of names, each between spaces."""
    import ahocorasick

    if names.id not in _built:
        made = ahocorasick.Automaton()
        for name in names.value:
            made.add_word(f" {name} ", name)
        made.make_automaton()
        _built.clear()
        _built[names.id] = made
    return _built[names.id]


class _Names:
    """A broadcast value and what it is known by in a worker."""

    def __init__(self, held, ident: int):
        self.held, self.id = held, ident

    @property
    def value(self):
        return self.held.value


def _by_automaton(worded: DataFrame, names: list[str]) -> DataFrame:
    spark = worded.sparkSession
    held = spark.sparkContext.broadcast(names)
    known = _Names(held, held._jbroadcast.id() if held._jbroadcast is not None else id(held))
    columns = worded.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(known)
        for pdf in pdfs:
            found = []
            for words in pdf["_words"]:
                line = f" {' '.join(words)} "
                # A space ends one name and may begin the next, so every end is found, whatever overlaps.
                ends = [(end - len(name) - 1, name) for end, name in automaton.iter(line)]
                found.append([{"at": line.count(" ", 0, start), "n": name.count(" ") + 1, "alias": name} for start, name in ends])
            yield pdf[columns].assign(_found=found)

    schema = worded.select("*").schema
    return worded.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, _found {_FOUND}")


def _by_join(worded: DataFrame, names: DataFrame) -> DataFrame:
    """The same by joining every run of up to MOST_WORDS words."""
    n = F.explode(F.sequence(F.lit(1), F.lit(MOST_WORDS)))
    grams = worded.select("*", n.alias("n")).filter(F.col("n") <= F.size("_words"))
    grams = grams.select("*", F.posexplode(F.sequence(F.lit(1), F.size("_words") - F.col("n") + 1)).alias("at", "_first"))
    grams = grams.withColumn("_gram", F.array_join(F.slice("_words", F.col("_first"), F.col("n")), " "))
    hits = grams.join(names, F.col("_gram") == F.col("alias")).groupBy("_key").agg(F.collect_list(F.struct("at", "n", "alias")).alias("_found"))
    return worded.join(hits.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left").drop("_k").withColumn("_found", F.coalesce("_found", F.array().cast(_FOUND)))


def _is(value: Column, among: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*among), F.lit(False))


def scan(texts: DataFrame, places: DataFrame, key: str = "id", most_names: int = MOST_NAMES) -> DataFrame:
    """(``key``, alias, place, kind, town, lat, lon, at, scoped): the place each text names, texts without one left out.

    ``texts``: key (each once), text, towns (array, its scope; null or empty: none); ``places``: alias (plain words),
    place, kind ('town', 'road', 'rail' or another), town, lat, lon.  A place in scope wins, then one that is no town, then
    the longer name, the first; shorter names are not looked at once one in scope that is no town is found.  A town out of scope
    is none.  A name is no place if a type of street follows it, if it is an address (a number before a single word or a name
    that ends in a type), if it is a station named like a town or street in a text without a word of trains, or a numbered
    road without a word for it.
    """
    worded = texts.select(F.col(key).alias("_key"), F.coalesce("towns", F.array().cast("array<string>")).alias("_towns"), tx.tokens(F.col("text")).alias("_words"))
    names = places.select("alias").filter("alias <> ''").distinct()
    some = [r.alias for r in names.limit(most_names + 1).collect()]
    found = _by_automaton(worded, some) if len(some) <= most_names else _by_join(worded, names)
    towns = places.filter("kind = 'town'").select(F.col("alias").alias("_ta")).distinct().withColumn("_like_town", F.lit(True))
    known = places.join(towns, F.col("alias") == F.col("_ta"), "left").select("alias", "place", "kind", "town", "lat", "lon", F.coalesce("_like_town", F.lit(False)).alias("_like_town"))
    # A place found by name is one row with all places of that name, of which it takes the best, so rows are as many as names in texts.
    known = known.groupBy(F.col("alias").alias("_alias"), "_like_town").agg(F.collect_list(F.struct("place", "kind", "town", "lat", "lon")).alias("_places"))
    known = F.broadcast(known) if len(some) <= most_names and places.limit(most_names + 1).count() <= most_names else known
    hits = found.select("_key", "_towns", "_words", F.inline("_found")).join(known, F.col("alias") == F.col("_alias"))
    before, after = F.get("_words", F.col("at") - 1), F.get("_words", F.col("at") + F.col("n"))
    typed = _is(F.element_at(F.split("alias", " "), -1), STREET_TYPES) & (F.col("n") > 1)
    address = ((F.col("n") == 1) | typed) & F.coalesce(before.rlike("^[0-9]+$"), F.lit(False))
    no_rail = (typed | F.col("_like_town")) & ~F.arrays_overlap("_words", F.array(*map(F.lit, RAIL_CUES)))
    no_road = F.col("alias").rlike("[0-9]") & ~_is(before, ROAD_CUES) & ~_is(after, DIRECTIONS)
    told = {"_spotless": _is(after, STREET_TYPES) | address, "_no_rail": no_rail, "_no_road": no_road, "_some": F.size("_towns") > 0, "_long": F.length("alias")}
    hits = hits.withColumns(told)

    def scoped(p: Column) -> Column:
        return F.coalesce(F.array_contains("_towns", p["town"]), F.lit(False))

    def fits(p: Column) -> Column:
        spot = ~p["kind"].isin("road", "town")
        elsewhere = (p["kind"] == "town") & ~scoped(p) & F.col("_some")
        return ~(spot & F.col("_spotless")) & ~((p["kind"] == "rail") & F.col("_no_rail")) & ~((p["kind"] == "road") & F.col("_no_road")) & ~elsewhere

    def rated(p: Column) -> Column:
        score = F.when(scoped(p), SCOPED).otherwise(0) + F.when(p["kind"] == "town", 0).otherwise(NAMED) + F.col("_long")
        return F.struct((-score).alias("score"), p["place"].alias("place"), *(p[c].alias(c) for c in ("kind", "town", "lat", "lon")), scoped(p).alias("scoped"))

    hits = hits.withColumn("_best", F.array_min(F.transform(F.filter("_places", fits), rated))).filter("_best IS NOT NULL")
    fit = hits.select("_key", "alias", "n", "at", "_best.*").withColumnRenamed("score", "_low")
    # One order for both windows, so that rows are sorted once.
    line = Window.partitionBy("_key").orderBy("_low", F.desc("n"), "at", "place")
    enough = F.max(F.when(F.col("_low") <= -ENOUGH, F.col("n"))).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fit = fit.withColumn("_enough", enough).filter(F.col("_enough").isNull() | (F.col("n") >= F.col("_enough")))
    best = F.row_number().over(line)
    return fit.withColumn("_r", best).filter("_r = 1").select(F.col("_key").alias(key), "alias", "place", "kind", "town", "lat", "lon", "at", "scoped")
