"""Queries of the outside sources: cursors, docks, transit, crowds, venues, outages, cameras, and the state of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.functions import geo, scoring
from beaconlake.functions import text as tx
from beaconlake.operators import aggregates, joins, ordered
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import grid_lat, grid_lon, messages, table

HOUR = 3_600_000_000
#: The cursor and the present of the queries, parameters of the operators: 2024-01-15 and 2024-01-30 UTC.
CURSOR, NOW = 1_705_276_800_000_000, 1_706_572_800_000_000


def after_cursor(df: DataFrame, at: str, tie: str, cursor: int, cap: int) -> DataFrame:
    """The first ``cap`` rows strictly after ``cursor``, and the cursor to go on from, the time of the last of them."""
    page = df.filter(F.col(at) > cursor).orderBy(at, tie).limit(cap)
    return page.crossJoin(F.broadcast(page.agg(F.max(at).alias("next_cursor"))))  # one row


def cursor_read(spark: SparkSession, sf: str) -> DataFrame:
    return after_cursor(messages(spark, sf).select("event_id", "at_us", "feed"), "at_us", "event_id", CURSOR, 500)


def live_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Of the newest 120 rows those strictly after the present."""
    newest = messages(spark, sf).select("event_id", "at_us", "feed").orderBy(F.desc("at_us"), F.desc("event_id")).limit(120)
    return newest.filter(F.col("at_us") > NOW)


def dock_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bikes of each station against the snapshot nearest to 15 hours before (4 to 45 hours old): arrivals and departures."""
    m = messages(spark, sf).groupBy("feed", (F.floor(F.col("at_us") / HOUR) * HOUR).alias("hour")).agg(F.count("*").alias("bikes"))
    m = m.withColumn("snap", F.monotonically_increasing_id() * 0)
    then = joins.asof_nearest(m, m, "feed", "hour", "bikes", "snap", 15 * HOUR, 4 * HOUR, 45 * HOUR, "then_bikes").drop("snap")
    both = then.join(m.select(F.col("feed").alias("_f"), F.col("hour").alias("_h"), "bikes"), (F.col("feed") == F.col("_f")) & (F.col("hour") == F.col("_h")))
    both = both.withColumn("delta", F.col("bikes") - F.col("then_bikes"))
    stations = table(spark, sf, "supplier").select(F.concat(F.lit("feed-"), F.col("s_suppkey").cast("string")).alias("_s"), F.col("s_name").alias("station"), F.col("s_acctbal").alias("_a")).filter("_a > 0")
    known = both.join(stations, F.col("feed") == F.col("_s"))
    return aggregates.flow_totals(known, "station", "delta", ignore=0, suspect=4)


def transit_people(spark: SparkSession, sf: str) -> DataFrame:
    """People aboard each vehicle (order): from its carriages (lines) that report an occupancy, else from the word of its status."""
    cars = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 10, F.col("l_quantity") * 2).alias("occupancy"))
    cars = cars.groupBy("l_orderkey").agg(F.count("*").alias("cars"), F.count("occupancy").alias("reporting"), F.sum(F.col("occupancy") / 100 * 150).alias("people"))
    status = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0.95).when(F.col("o_orderstatus") == "O", 0.15).alias("part"))
    both = status.join(cars, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("cars", F.coalesce("cars", F.lit(0)))
    people = F.when(F.col("reporting") > 0, F.col("people")).otherwise(F.col("part") * 150 * F.greatest(F.lit(1), F.col("cars")))
    method = F.when(F.col("reporting") > 0, "carriage").when(F.col("part").isNotNull(), "status")
    return both.withColumn("method", method).filter("method IS NOT NULL").groupBy("method").agg(F.count("*").alias("vehicles"), F.round(F.sum(people), 4).alias("people"), F.sum("cars").alias("cars"))


def crowd_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Share and phase of the crowd of every event (error calls; 60 to 159 minutes long) half an hour past noon of its day."""
    m = messages(spark, sf).filter("call_type = 'error'").withColumn("minutes", (F.floor(F.col("at_us") / (24 * HOUR)) * 24 * HOUR + 12.5 * HOUR - F.col("at_us")) / 60e6)
    c = m.withColumn("c", scoring.crowd_share(F.col("minutes"), F.lit(60.0) + F.col("k")))
    return c.select("event_id", F.round("c.share", 6).alias("share"), F.col("c.phase").alias("phase"))


def venue_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Venues whose live reading is 20 or more off the forecast, the multipliers that follow, and whether any near hour is open."""
    m = messages(spark, sf).filter("call_type = 'view'").withColumn("forecast", F.col("event_id") * 37 % 100)
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when((h + F.col("event_id")) % 6 == 0, 10).otherwise(0))
    turned = scoring.rotated(hours, F.lit(6))
    m = m.withColumn("hours", turned).filter(F.abs(F.col("k") - F.col("forecast")) >= 20)
    return m.select(
        "event_id", F.col("k").alias("live"), "forecast", F.round(scoring.live_multiplier(F.col("k"), F.col("forecast")), 6).alias("multiplier"),
        F.round(scoring.flow_multiplier(F.col("k") - F.col("forecast")), 6).alias("flow"), scoring.open_near(F.col("hours"), F.col("k") % 24).alias("open"),
    )


def venue_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Places by the 4 x 4 tiles of the box that find them, with a seam around each tile; a place counts for the first tile."""
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id"), grid_lat(F.col("s_suppkey")).alias("lat"), grid_lon(F.col("s_suppkey")).alias("lon"))
    # A place lies in the tile of its cell and, near a seam, in the neighbours': cells, not a join of all tiles with all places.
    reach = F.array(F.lit(-0.005), F.lit(0.0), F.lit(0.005))
    cell = lambda v, low: F.floor((v - low) / 0.1).cast("int")
    rows = p.withColumn("i", F.explode(F.array_distinct(F.transform(reach, lambda d: cell(F.col("lat") + d, 42.2)))))
    rows = rows.withColumn("j", F.explode(F.array_distinct(F.transform(reach, lambda d: cell(F.col("lon") + d, -71.2))))).filter("i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 3")
    first = rows.groupBy("place_id").agg(F.min(F.col("i") * 4 + F.col("j")).alias("tile"))
    return first.groupBy("tile").agg(F.count("*").alias("venues"), F.min("place_id").alias("first_id"))


def outages(spark: SparkSession, sf: str) -> DataFrame:
    """Towns without power: aliased columns, numbers with separators, the centroid of two squares, the box, and what was skipped."""
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("out"))
    props = n.select(
        "c_nationkey",
        F.when(F.col("c_nationkey") % 2 == 0, F.format_number("out", 0)).alias("customers_out"), F.when(F.col("c_nationkey") % 2 == 1, F.col("out").cast("string")).alias("cust_out"),
        F.when(F.col("c_nationkey") % 7 != 3, F.format_number("total", 0)).alias("served"),
    )
    x, y = grid_lon(F.col("c_nationkey")), grid_lat(F.col("c_nationkey"))
    ring = lambda side, dx: F.array(*[F.struct((x + dx + a * side).alias("x"), (y + b * side).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    d = props.withColumn("out", tx.number(F.coalesce("customers_out", "cust_out"))).withColumn("total", tx.number(F.col("served")))
    d = d.withColumn("centre", geo.multi_centroid(F.array(ring(0.01, 0.0), ring(0.02, 0.05))))
    shown = (F.col("out") > 0) & F.col("centre.x").between(-71.15, -70.6) & F.col("centre.y").between(42.0, 42.9)
    pct = F.when(F.col("total") > 0, F.round(F.col("out") / F.col("total") * 100, 1))
    return d.select(F.col("c_nationkey").alias("town"), F.col("out").cast("bigint").alias("out"), pct.alias("pct"), F.round("centre.x", 5).alias("lon"), F.round("centre.y", 5).alias("lat"), F.coalesce(shown, F.lit(False)).alias("shown"))


def outage_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = outages(spark, sf)
    return t.agg(F.sum(F.when(F.col("shown"), F.col("out")).otherwise(0)).alias("out"), F.count_if("shown").alias("towns"), F.count_if(F.expr("NOT shown AND out > 0")).alias("off_map"), F.count_if(F.col("out").isNull()).alias("skipped"))


_TITLE_SQL = "CASE p_size % 4 WHEN 0 THEN 'I-' || (p_size % 9 + 1) || ': NB - MM' || p_size || ' - Town' || (p_partkey % 12) || ' - ' || p_name WHEN 1 THEN 'Route ' || p_size || ': MM' || p_size || 'S - Town' || (p_partkey % 12) WHEN 2 THEN 'SR ' || p_size || ': EB - Town' || (p_partkey % 12) ELSE p_name END"


def cameras(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras with a picture, once each, with route, direction, mile marker and town of their titles, counted by town and direction."""
    c = table(spark, sf, "part").filter("p_type != 'PROMO'").selectExpr("p_brand || '/' || (p_partkey % 500) AS id", "p_partkey", "p_retailprice > 900.5 AS active", f"{_TITLE_SQL} AS title")
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("p_partkey"))).filter("_r = 1")
    title = F.col("title")
    rest = F.regexp_replace(title, "^[^:]*: ", "")
    glued = F.regexp_extract(rest, r"MM[0-9]+([NSEW])\b", 1)
    alone = F.regexp_extract(rest, r"(?:^| )([NSEW])B(?: |$)", 1)
    town = F.regexp_extract(rest, r"(Town[0-9]+)", 1)
    c = c.withColumns({"route": F.regexp_extract(title, "^([^:]*):", 1), "dir": F.when(alone != "", alone).otherwise(glued), "marker": F.regexp_extract(rest, r"(MM[0-9]+)", 1), "town": town})
    return c.groupBy("town", "dir").agg(F.count("*").alias("n"), F.count_if("active").alias("active"), F.countDistinct("route").alias("routes"), F.countDistinct("marker").alias("markers"), F.min("id").alias("first_id"))


def coincident_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Points of one grid cell fanned out on a circle around it, in order."""
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id"), F.floor(F.col("s_suppkey") % 40).alias("cell"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("place_id"))
    n = F.count("*").over(Window.partitionBy("cell"))
    angle = 2 * F.pi() * (rank - 1) / n
    radius = F.when(n > 1, 0.001).otherwise(0.0)
    return p.select("place_id", "cell", n.alias("siblings"), F.round(radius * F.cos(angle), 6).alias("dx"), F.round(radius * F.sin(angle), 6).alias("dy"))


def feed_states(spark: SparkSession, sf: str) -> DataFrame:
    """The newest word of every feed at the present: age in words, offline, forgotten, and the verdict."""
    m = messages(spark, sf).filter(F.col("at_us") <= NOW)
    h = m.groupBy("feed").agg(F.max("at_us").alias("audio"), F.max(F.when(F.col("k") >= 50, F.col("at_us"))).alias("speech"), F.countDistinct("unit").alias("total"), F.countDistinct(F.when(F.col("at_us") > NOW - 400 * HOUR, F.col("unit"))).alias("heard"))
    age = (F.lit(NOW) - F.col("audio")) / 1e6
    said = (F.lit(NOW) - F.col("speech")) / 1e6
    verdict = scoring.freshness(F.col("total"), F.col("total") - F.col("heard"), age, said, stale=3 * 3600, dark=8 * 3600, quiet=2 * 3600)
    return h.filter(age <= 86400).select("feed", scoring.age_phrase(age).alias("age"), (age > 7200).alias("offline"), verdict.alias("level"))


_AGE = lambda s: f"""CASE WHEN floor({s} + 0.5) < 90 THEN CAST(CAST(floor({s} + 0.5) AS BIGINT) AS STRING) || 's' WHEN floor(floor({s} + 0.5) / 60 + 0.5) < 90 THEN CAST(CAST(floor(floor({s} + 0.5) / 60 + 0.5) AS BIGINT) AS STRING) || 'm'
  WHEN floor(floor({s} + 0.5) / 60 + 0.5) / 60 < 48 THEN printf('%.1fh', floor(floor(floor({s} + 0.5) / 60 + 0.5) / 6 + 0.5) / 10) ELSE CAST(CAST(floor(floor(floor({s} + 0.5) / 60 + 0.5) / 1440 + 0.5) AS BIGINT) AS STRING) || 'd' END"""  # noqa: E731


def age_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Every age of the order keys in seconds, in words."""
    return table(spark, sf, "orders").select("o_orderkey", scoring.age_phrase(F.col("o_orderkey") * 37.5).alias("age"))


def machine_memo(spark: SparkSession, sf: str) -> DataFrame:
    """The latest reading of every unit that is not older than 55 hours: a memo with an expiry."""
    m = ordered.last_n(messages(spark, sf).filter(F.col("at_us") <= NOW).select("unit", "event_id", "at_us", "k"), ["unit"], [F.desc("at_us"), F.desc("event_id")], 1)
    return m.filter(F.col("at_us") >= NOW - 55 * HOUR).drop("back")


_SHARE_SQL = """CASE WHEN minutes < -90 THEN 0 WHEN minutes < 0 THEN CAST(0.85 AS DOUBLE) * (minutes + 90) / 90 WHEN minutes <= long THEN CASE WHEN minutes / long < 0.2 THEN CAST(0.85 AS DOUBLE) + CAST(0.15 AS DOUBLE) * (minutes / long / CAST(0.2 AS DOUBLE)) ELSE 1 END
  WHEN minutes < long + 45 THEN 1 - (minutes - long) / 45 ELSE 0 END"""

QUERIES: dict[str, Query] = {
    "cursor_read": Query(
        cursor_read, ("S9",),
        f"WITH {M}, p AS (SELECT event_id, at_us, feed FROM messages WHERE at_us > {CURSOR} ORDER BY at_us, event_id LIMIT 500) SELECT *, max(at_us) OVER () AS next_cursor FROM p",
    ),
    "live_buffer": Query(live_buffer, ("S10", "W3"), f"WITH {M}, p AS (SELECT event_id, at_us, feed FROM messages ORDER BY at_us DESC, event_id DESC LIMIT 120) SELECT * FROM p WHERE at_us > {NOW}"),
    "dock_flow": Query(
        dock_flow, ("S11", "W5", "G8", "J6"),
        f"""WITH {M}, h AS (SELECT feed, at_us // {HOUR} * {HOUR} AS hour, count(*) AS bikes FROM messages GROUP BY 1, 2),
        j AS (SELECT a.feed, a.hour, a.bikes - b.bikes AS delta, row_number() OVER (PARTITION BY a.feed, a.hour ORDER BY abs(a.hour - {15 * HOUR} - b.hour), b.hour) AS p FROM h a JOIN h b ON a.feed = b.feed AND a.hour - b.hour BETWEEN {4 * HOUR} AND {45 * HOUR}),
        d AS (SELECT s_name AS station, delta FROM j JOIN supplier ON feed = 'feed-' || s_suppkey WHERE p = 1 AND s_acctbal > 0)
        SELECT station, CAST(sum(CASE WHEN delta > 0 AND delta < 4 THEN delta ELSE 0 END) AS BIGINT) AS arrivals, CAST(sum(CASE WHEN delta < 0 AND delta > -4 THEN -delta ELSE 0 END) AS BIGINT) AS departures,
          count(*) FILTER (abs(delta) >= 4) AS suspect, CAST(sum(CASE WHEN abs(delta) > 0 AND abs(delta) < 4 THEN delta ELSE 0 END) AS BIGINT) AS net FROM d GROUP BY station""",
    ),
    "transit_people": Query(
        transit_people, ("S12",),
        """WITH c AS (SELECT l_orderkey, count(*) AS cars, count(*) FILTER (l_quantity > 10) AS reporting, sum(CASE WHEN l_quantity > 10 THEN l_quantity * 2 / 100 * 150 END) AS people FROM lineitem GROUP BY 1),
        b AS (SELECT coalesce(cars, 0) AS cars, coalesce(reporting, 0) AS reporting, people, CASE o_orderstatus WHEN 'F' THEN CAST(0.95 AS DOUBLE) WHEN 'O' THEN CAST(0.15 AS DOUBLE) END AS part FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)
        SELECT CASE WHEN reporting > 0 THEN 'carriage' ELSE 'status' END AS method, count(*) AS vehicles, round(sum(CASE WHEN reporting > 0 THEN people ELSE part * 150 * greatest(1, cars) END), 4) AS people, CAST(sum(cars) AS BIGINT) AS cars
        FROM b WHERE reporting > 0 OR part IS NOT NULL GROUP BY 1""",
    ),
    "crowd_curve": Query(
        crowd_curve, ("S13", "F27"),
        f"""WITH {M}, m AS (SELECT event_id, (at_us // {24 * HOUR} * {24 * HOUR} + {HOUR * 25 // 2} - at_us) / CAST(60000000 AS DOUBLE) AS minutes, CAST(60 + k AS DOUBLE) AS long FROM messages WHERE call_type = 'error')
        SELECT event_id, round({_SHARE_SQL}, 6) AS share, CASE WHEN minutes < -90 THEN 'pending' WHEN minutes < 0 THEN 'building' WHEN minutes <= long THEN 'peak' WHEN minutes < long + 45 THEN 'dispersing' ELSE 'ended' END AS phase FROM m""",
    ),
    "venue_anomalies": Query(
        venue_anomalies, ("S14", "F28", "F29", "F30"),
        f"""WITH {M}, v AS (SELECT event_id, k AS live, event_id * 37 % 100 AS forecast FROM messages WHERE call_type = 'view')
        SELECT event_id, live, forecast, round((live + 8) / CAST(greatest(forecast, 0) + 8 AS DOUBLE), 6) AS multiplier, round(1 + greatest(CAST(-0.5 AS DOUBLE), least(CAST(0.5 AS DOUBLE), (live - forecast) / CAST(20 AS DOUBLE))), 6) AS flow,
          list_bool_or(list_transform([-2, -1, 0, 1, 2], lambda d: ((live % 24 + d + 24) % 24 + 6) % 24 % 6 = (6 - event_id % 6) % 6)) AS open FROM v WHERE abs(live - forecast) >= 20""",
    ),
    "venue_sweep": Query(
        venue_sweep, ("S15",),
        """WITH p AS (SELECT s_suppkey AS place_id, CAST(42.2 AS DOUBLE) + CAST(s_suppkey * 7919 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS lat, CAST(-71.2 AS DOUBLE) + CAST(s_suppkey * 104729 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS lon FROM supplier),
        d(x) AS (VALUES (CAST(-0.005 AS DOUBLE)), (CAST(0.0 AS DOUBLE)), (CAST(0.005 AS DOUBLE))),
        c AS (SELECT place_id, floor((lat + a.x - CAST(42.2 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) AS i, floor((lon + b.x - CAST(-71.2 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) AS j FROM p, d a, d b),
        f AS (SELECT place_id, CAST(min(i * 4 + j) AS INTEGER) AS tile FROM c WHERE i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 3 GROUP BY 1)
        SELECT tile, count(*) AS venues, min(place_id) AS first_id FROM f GROUP BY tile""",
    ),
    "outages": Query(
        outages, ("S16", "F8", "F33", "P4"),
        """WITH n AS (SELECT c_nationkey AS town, count(*) AS total, count(*) FILTER (c_acctbal < 0) AS out FROM customer GROUP BY 1),
        c AS (SELECT *, CAST(-71.2 AS DOUBLE) + CAST(CAST(town AS BIGINT) * 104729 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS x, CAST(42.2 AS DOUBLE) + CAST(CAST(town AS BIGINT) * 7919 % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE) AS y FROM n),
        g AS (SELECT *, ((x + CAST(0.005 AS DOUBLE)) * CAST(0.0001 AS DOUBLE) + (x + CAST(0.06 AS DOUBLE)) * CAST(0.0004 AS DOUBLE)) / CAST(0.0005 AS DOUBLE) AS lon, ((y + CAST(0.005 AS DOUBLE)) * CAST(0.0001 AS DOUBLE) + (y + CAST(0.01 AS DOUBLE)) * CAST(0.0004 AS DOUBLE)) / CAST(0.0005 AS DOUBLE) AS lat FROM c)
        SELECT town, out, CASE WHEN town % 7 <> 3 THEN round(out / CAST(total AS DOUBLE) * 100, 1) END AS pct, round(lon, 5) AS lon, round(lat, 5) AS lat, out > 0 AND lon BETWEEN -71.15 AND -70.6 AND lat BETWEEN 42.0 AND 42.9 AS shown FROM g""",
    ),
    "cameras": Query(
        cameras, ("S17", "G18", "F32"),
        f"""WITH c AS (SELECT p_brand || '/' || (p_partkey % 500) AS id, p_partkey, p_retailprice > 900.5 AS active, {_TITLE_SQL} AS title FROM part WHERE p_type <> 'PROMO' QUALIFY row_number() OVER (PARTITION BY p_brand || '/' || (p_partkey % 500) ORDER BY p_partkey) = 1),
        r AS (SELECT *, regexp_replace(title, '^[^:]*: ', '') AS rest, regexp_extract(title, '^([^:]*):', 1) AS route FROM c),
        f AS (SELECT *, regexp_extract(rest, '(Town[0-9]+)', 1) AS town, regexp_extract(rest, '(MM[0-9]+)', 1) AS marker,
          CASE WHEN regexp_extract(rest, '(?:^| )([NSEW])B(?: |$)', 1) <> '' THEN regexp_extract(rest, '(?:^| )([NSEW])B(?: |$)', 1) ELSE regexp_extract(rest, 'MM[0-9]+([NSEW])\\b', 1) END AS dir FROM r)
        SELECT town, dir, count(*) AS n, count(*) FILTER (active) AS active, count(DISTINCT route) AS routes, count(DISTINCT marker) AS markers, min(id) AS first_id FROM f GROUP BY town, dir""",
    ),
    "coincident_markers": Query(
        coincident_markers, ("F36", "B29"),
        """WITH p AS (SELECT s_suppkey AS place_id, s_suppkey % 40 AS cell, count(*) OVER (PARTITION BY s_suppkey % 40) AS siblings, row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey) - 1 AS r FROM supplier)
        SELECT place_id, cell, siblings, round(CASE WHEN siblings > 1 THEN CAST(0.001 AS DOUBLE) ELSE 0 END * cos(2 * pi() * r / siblings), 6) AS dx, round(CASE WHEN siblings > 1 THEN CAST(0.001 AS DOUBLE) ELSE 0 END * sin(2 * pi() * r / siblings), 6) AS dy FROM p""",
    ),
    "feed_states": Query(
        feed_states, ("C15", "ST9", "G17"),
        f"""WITH {M}, h AS (SELECT feed, ({NOW} - max(at_us)) / CAST(1000000 AS DOUBLE) AS age, ({NOW} - max(at_us) FILTER (k >= 50)) / CAST(1000000 AS DOUBLE) AS said, count(DISTINCT unit) AS total, count(DISTINCT unit) FILTER (at_us > {NOW - 400 * HOUR}) AS heard FROM messages WHERE at_us <= {NOW} GROUP BY feed)
        SELECT feed, {_AGE('age')} AS age, age > 7200 AS offline, CASE WHEN age >= 28800 THEN 'dark' WHEN heard = 0 THEN 'dark' WHEN heard < total THEN 'degraded' WHEN age >= 10800 THEN 'stale' WHEN said IS NULL OR said >= 7200 THEN 'quiet' ELSE 'live' END AS level FROM h WHERE age <= 86400""",
    ),
    "age_phrases": Query(age_phrases, ("F22",), f"SELECT o_orderkey, {_AGE('(o_orderkey * CAST(37.5 AS DOUBLE))')} AS age FROM orders"),
    "machine_memo": Query(
        machine_memo, ("B21",),
        f"WITH {M} SELECT unit, event_id, at_us, k FROM messages WHERE at_us <= {NOW} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY at_us DESC, event_id DESC) = 1 AND at_us >= {NOW - 55 * HOUR}",
    ),
}
QUERIES["outage_totals"] = Query(
    outage_totals, ("G9",),
    f"SELECT CAST(sum(CASE WHEN shown THEN out ELSE 0 END) AS BIGINT) AS out, count(*) FILTER (shown) AS towns, count(*) FILTER (NOT shown AND out > 0) AS off_map, count(*) FILTER (out IS NULL) AS skipped FROM ({QUERIES['outages'].sql})",
)
