"""Queries whose next row depends on the last: tracks, circles, bursts with an age, scenes merged into stars.

Their SQL walks row by row, in recursive queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.operators import ordered, scenes, tracks
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import grid_lat, grid_lon, messages

MINUTE = 60_000


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fixes of their units, a thousand times as fast: some come late, some stand still, some are a degree away."""
    k, at = F.col("k"), F.floor(F.col("at_us") / 1_000_000).cast("bigint")
    lat = F.lit(42.0) + F.when(k >= 92, 1.0).when(k < 40, k % 4 * 0.005).otherwise(0.0) + F.when(k % 6 == 0, 0.0001 * (k % 5)).otherwise(0.0)
    seq = F.when(k % 9 == 0, F.col("at_us") - 40_000_000_000).otherwise(F.col("at_us"))
    return messages(spark, sf).select(F.col("unit").alias("key"), seq.alias("seq"), at.alias("at_ms"), lat.alias("lat"), (F.lit(-71.0) + k % 3 * 0.004).alias("lon"), (k * 60.0).alias("alt"))


_FAR = "2 * CAST(6371000 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin((radians({a}lat) - radians({b}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_far = lambda a, b: _FAR.format(a=a, b=b)
_FIXES = f"""WITH RECURSIVE {M}, fixes AS (
  SELECT unit AS key, at_us - CASE WHEN k % 9 = 0 THEN 40000000000 ELSE 0 END AS seq, CAST(floor(at_us / 1000000.0) AS BIGINT) AS at_ms,
    CAST(42 AS DOUBLE) + CASE WHEN k >= 92 THEN CAST(1 AS DOUBLE) WHEN k < 40 THEN k % 4 * CAST(0.005 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN k % 6 = 0 THEN CAST(0.0001 AS DOUBLE) * (k % 5) ELSE CAST(0 AS DOUBLE) END AS lat,
    CAST(-71 AS DOUBLE) + k % 3 * CAST(0.004 AS DOUBLE) AS lon, k * CAST(60 AS DOUBLE) AS alt FROM messages),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM fixes),
walked AS (
  SELECT key, n, 'begins' AS verdict, at_ms AS h_at, lat AS h_lat, lon AS h_lon, 0 AS doubted FROM placed WHERE n = 1
  UNION ALL
  SELECT key, n, verdict, CASE WHEN takes THEN at_ms ELSE h_at END, CASE WHEN takes THEN lat ELSE h_lat END, CASE WHEN takes THEN lon ELSE h_lon END,
    CASE WHEN verdict = 'leaps' THEN doubted + 1 WHEN verdict IN ('early', 'crowded') THEN doubted ELSE 0 END
  FROM (SELECT *, verdict IN ('resumes', 'lands', 'moves', 'beats') AS takes FROM (
    SELECT p.key, p.n, p.at_ms, p.lat, p.lon, h_at, h_lat, h_lon, doubted, CASE
      WHEN p.at_ms < h_at THEN 'early' WHEN p.at_ms - h_at >= {tracks.GAP_MS} THEN 'resumes' WHEN p.at_ms - h_at < {tracks.MIN_DT_MS} THEN 'crowded'
      WHEN {_far("h_", "p.")} * 3600000 > {tracks.MAX_KNOTS * 1852} * (p.at_ms - h_at) THEN CASE WHEN doubted < {tracks.MAX_BAD} THEN 'leaps' ELSE 'lands' END
      WHEN {_far("h_", "p.")} >= {tracks.MIN_MOVE_M} THEN 'moves' WHEN p.at_ms - h_at >= {tracks.HEARTBEAT_MS} THEN 'beats' ELSE 'rests' END AS verdict
    FROM walked w JOIN placed p ON p.key = w.key AND p.n = w.n + 1))),
judged AS (SELECT p.*, verdict, verdict IN ('begins', 'resumes', 'lands') AS cut, verdict IN ('begins', 'resumes', 'lands', 'moves', 'beats') AS taken FROM walked JOIN placed p USING (key, n)),
present AS (SELECT max(at_ms) AS now_ms FROM fixes)"""


def track_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every fix."""
    return tracks.gated(fixes(spark, sf)).select("key", "seq", "at_ms", "taken", "cut", "verdict")


def _present(spark: SparkSession, sf: str) -> int:
    return fixes(spark, sf).agg(F.max("at_ms")).first()[0] or 0


def track_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Believed fixes of the last half hour by leg, and the tip of each leg."""
    found = tracks.legs(tracks.gated(fixes(spark, sf)), _present(spark, sf))
    return found.select("key", "seq", "at_ms", "leg", "tip")


def circling(spark: SparkSession, sf: str) -> DataFrame:
    """Units whose newest fixes hold together, and for how long."""
    return tracks.circling(tracks.gated(fixes(spark, sf)), _present(spark, sf)).select("key", "circles", "for_ms")


def aged_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, ten times as fast, with the begin of their burst: gaps of 12 minutes, an age of 20."""
    m = messages(spark, sf).select("event_id", "feed", F.floor(F.col("at_us") / 10_000).cast("bigint").alias("at_ms"))
    return ordered.aged_bursts(m, "feed", "at_ms", 12 * MINUTE, 20 * MINUTE, "event_id")


def scene_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Which scene each scene ends up in: twenty towns, thirty places, some addresses; twenty times as fast."""
    n, k = F.col("event_id"), F.col("k")
    start = F.floor(F.col("at_us") / 20_000).cast("bigint")
    rows = messages(spark, sf).select(
        F.concat(F.lit("town-"), F.substring("unit", 2, 20).cast("int") % 20).alias("town"), F.format_string("%012d", n).alias("scene"), start.alias("from_ms"), (start + k * 1000).alias("to_ms"), grid_lat(n % 30).alias("lat"), grid_lon(n % 30).alias("lon"),
        F.when(k % 3 == 0, F.concat(F.lit("street "), k % 7)).alias("address"), F.array().cast("array<string>").alias("words"), F.lit(False).alias("loose"),
    )
    return scenes.merged(rows)


_GRID = "CAST({base} AS DOUBLE) + CAST(event_id % 30 * {prime} % 1000 AS DOUBLE) / CAST(2500 AS DOUBLE)"

QUERIES: dict[str, Query] = {
    "track_gate": Query(track_gate, ("W11",), f"{_FIXES} SELECT key, seq, at_ms, taken, cut, verdict FROM judged"),
    "track_legs": Query(
        track_legs, ("W13",),
        f"""{_FIXES}, numbered AS (SELECT key, seq, at_ms, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY key ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS leg FROM judged, present WHERE taken AND at_ms >= now_ms - {tracks.TRAIL_MS}),
        sized AS (SELECT *, count(*) OVER (PARTITION BY key, leg) AS c, max(at_ms) OVER (PARTITION BY key, leg) AS last_ms FROM numbered)
        SELECT key, seq, at_ms, leg, at_ms >= last_ms - {tracks.TIP_MS} AS tip FROM sized WHERE c > 1""",
    ),
    "circling": Query(
        circling, ("W14",),
        f"""{_FIXES}, recent AS (SELECT key, at_ms, lat, lon, alt, cut, now_ms, row_number() OVER (PARTITION BY key ORDER BY at_ms DESC, seq DESC) AS r FROM judged, present WHERE taken AND at_ms BETWEEN now_ms - {tracks.LOITER_WINDOW_MS} AND now_ms),
        reach AS (SELECT a.key, a.r, max({_far("a.", "b.")}) AS far FROM recent a JOIN recent b ON a.key = b.key AND b.r <= a.r GROUP BY a.key, a.r),
        stop AS (SELECT key, min(CASE WHEN far > {2 * tracks.LOITER_M} THEN r WHEN cut THEN r + 1 END) AS r FROM recent JOIN reach USING (key, r) GROUP BY key),
        held AS (SELECT x.key, max(at_ms) - min(at_ms) AS span, count(*) AS c, max(at_ms) AS newest, arg_max(alt, -x.r) AS alt, max(now_ms) AS now_ms FROM recent x JOIN stop s ON s.key = x.key AND (s.r IS NULL OR x.r < s.r) GROUP BY x.key)
        SELECT key, c > 1 AND span >= {tracks.LOITER_MS} AND now_ms - newest <= {tracks.GAP_MS} AND alt <= {tracks.LOITER_FEET} AS circles, CASE WHEN circles THEN span ELSE 0 END AS for_ms FROM held""",
    ),
    "aged_bursts": Query(
        aged_bursts, ("W2",),
        f"""WITH RECURSIVE {M}, o AS MATERIALIZED (SELECT event_id, feed, CAST(floor(at_us / 10000.0) AS BIGINT) AS at_ms, row_number() OVER (PARTITION BY feed ORDER BY at_us, event_id) AS n FROM messages),
        b AS (SELECT event_id, feed, at_ms, n, at_ms AS burst_start FROM o WHERE n = 1
          UNION ALL SELECT o.event_id, o.feed, o.at_ms, o.n, CASE WHEN o.at_ms - b.at_ms > {12 * MINUTE} OR o.at_ms - b.burst_start > {20 * MINUTE} THEN o.at_ms ELSE b.burst_start END FROM b JOIN o ON o.feed = b.feed AND o.n = b.n + 1)
        SELECT event_id, feed, at_ms, burst_start FROM b""",
    ),
    "scene_merge": Query(
        scene_merge, ("J5",),
        f"""WITH RECURSIVE {M}, s AS (SELECT 'town-' || (CAST(substr(unit, 2) AS INT) % 20) AS town, printf('%012d', event_id) AS scene, CAST(floor(at_us / 20000.0) AS BIGINT) AS from_ms, CAST(floor(at_us / 20000.0) AS BIGINT) + k * 1000 AS to_ms,
          {_GRID.format(base=42.2, prime=7919)} AS lat, {_GRID.format(base=-71.2, prime=104729)} AS lon, CASE WHEN k % 3 = 0 THEN 'street ' || (k % 7) END AS address FROM messages),
        o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY town ORDER BY from_ms, scene) AS n FROM s),
        pairs AS MATERIALIZED (SELECT b.town, b.n, list(a.n) AS near FROM o a JOIN o b ON a.town = b.town AND a.n < b.n AND greatest(0, b.from_ms - a.to_ms) <= {scenes.MERGE_MS} AND (a.address = b.address OR
          sqrt(pow((b.lat - a.lat) * CAST(111194.92664455873 AS DOUBLE), 2) + pow((b.lon - a.lon) * CAST(111194.92664455873 AS DOUBLE) * cos(radians((a.lat + b.lat) / 2)), 2)) <= {scenes.SAME_PLACE_M}) GROUP BY b.town, b.n),
        w AS (SELECT town, CAST(1 AS BIGINT) AS n, [CAST(1 AS BIGINT)] AS seeds, CAST(1 AS BIGINT) AS home FROM (SELECT DISTINCT town FROM o)
          UNION ALL SELECT town, n, CASE WHEN hit IS NULL THEN list_append(seeds, n) ELSE seeds END, coalesce(hit, n)
          FROM (SELECT o.town, o.n, w.seeds, list_min(list_intersect(w.seeds, coalesce(p.near, CAST([] AS BIGINT[])))) AS hit FROM w JOIN o ON o.town = w.town AND o.n = w.n + 1 LEFT JOIN pairs p ON p.town = o.town AND p.n = o.n))
        SELECT o.town, o.scene, h.scene AS into FROM w JOIN o USING (town, n) JOIN o h ON h.town = w.town AND h.n = w.home""",
    ),
}
