"""Queries of the board: references to what is on it, weights of evidence, verdicts on places, capacity, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.functions import geo, scoring
from beaconlake.plans.calls import _SCENES_SQL, _scenes
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import grid_lat, grid_lon, messages, table

HOUR = 3_600_000_000


def known_references(spark: SparkSession, sf: str) -> DataFrame:
    """Reports (purchases) whose reference names something on the board (a supplier with a balance), others without it."""
    m = messages(spark, sf).filter("call_type = 'purchase'").select("event_id", F.col("k").cast("bigint").alias("ref"))
    board = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("_id"))
    kept = m.join(board, F.col("ref") == F.col("_id"), "left")
    return kept.select("event_id", F.col("_id").alias("updates"))


def evidence_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of each scene: a loose one (one feed, no unit twice) by what was said, a seeded one by its floor, tier, priority and units."""
    c = F.col
    s = _scenes(spark, sf)
    floor = scoring.severity_floor(c("grave"), c("heavy"), c("tier"), c("n"), c("feeds"), c("units"), c("span"), c("fire_ops"), c("fire_nothing"), F.lit("normal"), F.lit("normal"))
    s = s.select("*", F.explode(F.array(floor)).alias("f")).withColumn("loose", (c("feeds") == 1) & (c("n") < 2))
    high = F.when(c("high") == 1, 4).otherwise(0)
    seeded = c("f.score") * 10 + c("tier") * 3 + high + F.least(F.lit(3.0), c("units") / 3)
    return s.select("street", "day", "loose", F.round(F.when(c("loose"), (c("tier") * 10 + high).cast("double")).otherwise(seeded), 6).alias("weight"))


_WEIGHTS_SQL = f"""WITH {_SCENES_SQL}, b AS (SELECT *, CASE WHEN grave > 0 THEN 4.0 WHEN heavy > 0 OR tier >= 3 THEN 3.0 WHEN tier = 2 THEN 2.0 ELSE 1.0 END AS base, CASE WHEN grave > 0 THEN 4 WHEN heavy > 0 OR tier >= 3 THEN 3 ELSE 0 END AS h0, fire_ops >= 2 AND NOT fire_nothing AS burning FROM scenes),
s1 AS (SELECT *, base + CASE WHEN feeds >= 4 THEN 2.0 WHEN feeds = 3 THEN 1.0 WHEN feeds = 2 AND base >= 2 THEN 0.5 ELSE 0 END + CASE WHEN units >= 8 THEN 1.0 WHEN units >= 5 THEN 0.5 ELSE 0 END AS x FROM b),
s2 AS (SELECT *, x + CASE WHEN span >= 45 AND x >= 2 THEN 0.5 ELSE 0 END AS y FROM s1),
s3 AS (SELECT *, CASE WHEN burning THEN CASE WHEN y < 3 THEN 3.0 ELSE y + 0.5 END + CASE WHEN span >= 20 THEN 0.5 ELSE 0 END ELSE y END AS z, CASE WHEN burning THEN greatest(h0, 3) ELSE h0 END AS heard FROM s2),
s4 AS (SELECT *, greatest(0.0, least(5.0, floor(z * 2 + 0.5) / 2)) AS o FROM s3),
s5 AS (SELECT *, CASE WHEN heard = 0 AND o > 3 THEN 3.0 ELSE o END AS score, feeds = 1 AND n < 2 AS loose FROM s4)
SELECT street, day, loose, round(CASE WHEN loose THEN CAST(tier * 10 + CASE WHEN high = 1 THEN 4 ELSE 0 END AS DOUBLE) ELSE CAST(score AS DOUBLE) * 10 + tier * 3 + CASE WHEN high = 1 THEN 4 ELSE 0 END + least(3.0, units / CAST(3 AS DOUBLE)) END, 6) AS weight FROM s5"""


def place_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What a map's answer is good for: parts stand for answers with a class (type), a kind (brand) and perhaps a number."""
    kinds = F.element_at(F.array(*map(F.lit, ("house", "platform", "city", "footway", "suburb"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    classes = F.when(F.col("p_type") == "PROMO", "highway").when(F.col("p_type") == "LARGE", "boundary").when(F.col("p_type") == "SMALL", "place").otherwise("building")
    d = table(spark, sf, "part").select("p_partkey", kinds.alias("kind"), classes.alias("cls"), (F.col("p_size") % 3 == 0).alias("numbered"), (F.col("p_size") % 2 == 0).alias("wanted"))
    reject = F.col("kind").isin("platform", "footway") & (F.col("cls") != "building")
    verdict = F.when(reject, "reject").when(F.col("wanted") & ~F.col("numbered"), "approx").when(F.col("cls") == "boundary", "wide").when((F.col("cls") == "place") & F.col("kind").isin("city", "suburb"), "wide").otherwise("ok")
    return d.groupBy("cls", "kind", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def capacity(spark: SparkSession, sf: str) -> DataFrame:
    """How many more feeds each feed's machine could take at four fifths of its time: by the traffic seen, at most by a burst of all."""
    m = messages(spark, sf).groupBy("feed").agg((F.sum("value") / ((F.max("at_us") - F.min("at_us")) / 1e6)).alias("duty"), F.avg(F.col("k") / 5.0).alias("speed"), F.countDistinct("unit").alias("feeds"))
    burst = F.greatest(F.lit(0), F.floor(F.col("speed") * 0.8).cast("int") - F.col("feeds"))
    traffic = F.when(F.col("duty") > 0.02, F.greatest(F.lit(0), ((0.8 - F.col("duty")) / (F.col("duty") / F.col("feeds"))).cast("int"))).otherwise(burst)
    return m.select("feed", F.least(burst, traffic).cast("bigint").alias("headroom"), burst.cast("bigint").alias("burst"))


def near_pairs_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Of each town's six first places the three best pairs within 9 km: sum of their scores and a sixtieth of the distance in km."""
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("town"), grid_lat(F.col("s_suppkey")).alias("lat"), grid_lon(F.col("s_suppkey")).alias("lon"), F.round(F.abs("s_acctbal") / 10_000, 6).alias("score"))
    top = p.withColumn("_r", F.row_number().over(Window.partitionBy("town").orderBy("score", "id"))).filter("_r <= 6").drop("_r")
    x = top.select(F.col("town").alias("_t"), *(F.col(c).alias(f"{c}_a") for c in ("id", "lat", "lon", "score")))
    met = top.join(x, (F.col("town") == F.col("_t")) & (F.col("id_a") < F.col("id")))  # at most 15 pairs a town
    metres = geo.metres(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon"))
    ranked = met.withColumn("metres", metres).filter("metres <= 9000").withColumn("total", F.round(F.col("score") + F.col("score_a") + F.col("metres") / 60_000, 6))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("town").orderBy("total", "id_a", "id"))).filter("place <= 3").select("town", F.col("id_a").alias("a"), F.col("id").alias("b"), "total", "place")


def open_story_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 open orders of each market segment, newest first, as one block of lines of 40 characters at most."""
    o = table(spark, sf, "orders").filter("o_orderstatus != 'F'").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    top = o.withColumn("_r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_orderdate"), "o_orderkey"))).filter("_r <= 25")
    line = F.substring(F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit("] "), F.lower("o_orderpriority"), F.lit(" | opened "), F.date_format("o_orderdate", "yyyy-MM-dd")), 1, 40)
    rows = top.select("c_mktsegment", "_r", line.alias("line"))
    return rows.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x.line), "\n").alias("block"))


def windows_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that requests name: from and to where both are there and in order, else so many hours back, 1 to 24, ten without a number."""
    o = table(spark, sf, "orders").select("o_orderkey", F.unix_micros("o_orderdate").alias("now"), F.when(F.col("o_orderkey") % 3 == 0, F.unix_micros("o_orderdate") - (F.col("o_orderkey") % 7 - 1) * HOUR).alias("start"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 40 - 3).alias("hours"))
    named = F.col("start").isNotNull() & (F.col("start") < F.col("now"))
    back = F.greatest(F.lit(1), F.least(F.lit(24), F.coalesce("hours", F.lit(10))))
    return o.select("o_orderkey", F.when(named, F.col("start")).otherwise(F.col("now") - back * HOUR).alias("from_us"), named.alias("named"))


QUERIES: dict[str, Query] = {
    "known_references": Query(known_references, ("P7",), f"WITH {M} SELECT event_id, s_suppkey AS updates FROM messages LEFT JOIN supplier ON s_suppkey = k AND s_acctbal > 0 WHERE call_type = 'purchase'"),
    "evidence_weights": Query(evidence_weights, ("O10",), _WEIGHTS_SQL),
    "place_verdicts": Query(
        place_verdicts, ("C16",),
        """WITH d AS (SELECT ['house', 'platform', 'city', 'footway', 'suburb'][p_partkey % 5 + 1] AS kind, CASE p_type WHEN 'PROMO' THEN 'highway' WHEN 'LARGE' THEN 'boundary' WHEN 'SMALL' THEN 'place' ELSE 'building' END AS cls, p_size % 3 = 0 AS numbered, p_size % 2 = 0 AS wanted FROM part)
        SELECT cls, kind, CASE WHEN kind IN ('platform', 'footway') AND cls <> 'building' THEN 'reject' WHEN wanted AND NOT numbered THEN 'approx' WHEN cls = 'boundary' THEN 'wide' WHEN cls = 'place' AND kind IN ('city', 'suburb') THEN 'wide' ELSE 'ok' END AS verdict, count(*) AS n FROM d GROUP BY 1, 2, 3""",
    ),
    "capacity": Query(
        capacity, ("A8",),
        f"""WITH {M}, m AS (SELECT feed, sum(value) / ((max(at_us) - min(at_us)) / CAST(1000000 AS DOUBLE)) AS duty, avg(k / CAST(5 AS DOUBLE)) AS speed, count(DISTINCT unit) AS feeds FROM messages GROUP BY feed),
        b AS (SELECT *, greatest(0, CAST(floor(speed * CAST(0.8 AS DOUBLE)) AS BIGINT) - feeds) AS burst FROM m)
        SELECT feed, CAST(least(burst, CASE WHEN duty > 0.02 THEN greatest(0, CAST(trunc((CAST(0.8 AS DOUBLE) - duty) / (duty / feeds)) AS BIGINT)) ELSE burst END) AS BIGINT) AS headroom, burst FROM b""",
    ),
    "near_pairs_scored": Query(
        near_pairs_scored, ("J14",),
        """WITH p AS (SELECT s_suppkey AS id, s_suppkey % 5 AS town, CAST(42.2 AS DOUBLE) + CAST(s_suppkey * 7919 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS lat, CAST(-71.2 AS DOUBLE) + CAST(s_suppkey * 104729 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS lon, round(abs(s_acctbal) / 10000, 6) AS score FROM supplier),
        t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY town ORDER BY score, id) <= 6),
        j AS (SELECT a.town, a.id AS a, b.id AS b, sqrt(pow((b.lon - a.lon) * CAST(111194.92664455873 AS DOUBLE) * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * CAST(111194.92664455873 AS DOUBLE), 2)) AS metres, a.score + b.score AS s FROM t a JOIN t b ON a.town = b.town AND a.id < b.id)
        SELECT town, a, b, round(s + metres / 60000, 6) AS total, row_number() OVER (PARTITION BY town ORDER BY round(s + metres / 60000, 6), a, b) AS place FROM j WHERE metres <= 9000 QUALIFY place <= 3""",
    ),
    "open_story_blocks": Query(
        open_story_blocks, ("B16",),
        """WITH t AS (SELECT c_mktsegment, left('[' || o_orderkey || '] ' || lower(o_orderpriority) || ' | opened ' || strftime(o_orderdate, '%Y-%m-%d'), 40) AS line, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey) AS r
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F') SELECT c_mktsegment, string_agg(line, chr(10) ORDER BY r) AS block FROM t WHERE r <= 25 GROUP BY 1""",
    ),
    "windows_asked": Query(
        windows_asked, ("B15",),
        f"""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS now, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) - (o_orderkey % 7 - 1) * {HOUR} END AS start, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 40 - 3 END AS hours FROM orders)
        SELECT o_orderkey, CASE WHEN start < now THEN start ELSE now - greatest(1, least(24, coalesce(hours, 10))) * {HOUR} END AS from_us, coalesce(start < now, false) AS named FROM o""",
    ),
}
