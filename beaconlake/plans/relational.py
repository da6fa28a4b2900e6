"""Queries of the relational core: bursts, groups, counts, order statistics, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.functions import scoring
from beaconlake.functions.localtime import day_key, hour_key
from beaconlake.operators import aggregates, ordered
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import messages, table

MINUTE = 60_000_000
_TIER = "CASE call_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"


def burst_sessions(spark: SparkSession, sf: str) -> DataFrame:
    m = ordered.gap_bursts(messages(spark, sf), "feed", "at_us", 12 * MINUTE, "event_id")
    return m.groupBy("feed", "burst").agg(F.count("*").alias("n"), F.min("at_us").alias("from_us"), F.max("at_us").alias("to_us"), F.round(F.sum("value"), 4).alias("total"))


_BURSTS = f"""WITH {M}, marked AS (
  SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY feed ORDER BY at_us, event_id) <= 720000000 THEN 0 ELSE 1 END AS s FROM messages
), bursts AS (SELECT *, sum(s) OVER (PARTITION BY feed ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM marked)"""


def ranked_groups(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).withColumn("tier", F.expr(_TIER)).withColumn("score", F.col("k") / 10.0)
    m = ordered.gap_bursts(m, "unit", "at_us", 720 * MINUTE, "event_id").filter("score > 2")
    g = m.groupBy("unit", "burst").agg(
        F.max("score").alias("best"), F.count("*").alias("n"), F.max("tier").alias("tier"), F.countDistinct("call_type").alias("kinds"), F.min("at_us").alias("from_us"), F.max("at_us").alias("to_us")
    )
    g = g.withColumn("score", F.round(scoring.group_score(F.col("best"), F.col("n"), F.col("tier"), F.col("kinds")), 6))
    return g.orderBy(F.desc("score"), F.desc("to_us"), "unit").limit(40)


_RANKED = f"""WITH {M}, marked AS (
  SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY unit ORDER BY at_us, event_id) <= 43200000000 THEN 0 ELSE 1 END AS s FROM messages
), bursts AS (SELECT *, CAST(sum(s) OVER (PARTITION BY unit ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst, {_TIER} AS tier, k / CAST(10 AS DOUBLE) AS sc FROM marked)
SELECT unit, burst, max(sc) AS best, count(*) AS n, max(tier) AS tier, count(DISTINCT call_type) AS kinds, min(at_us) AS from_us, max(at_us) AS to_us,
       round(max(sc) + least(1.5, log2(1 + count(*))) + greatest(max(tier), 0) + least(2, greatest(0, count(DISTINCT call_type) - 1)), 6) AS score
FROM bursts WHERE sc > 2 GROUP BY unit, burst ORDER BY score DESC, to_us DESC, unit LIMIT 40"""


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).withColumn("seconds", F.floor("value").cast("bigint"))
    totals = m.groupBy(F.col("feed").alias("_feed")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("call_type") == "error").alias("stale"),
        F.max("seconds").alias("longest_s"),
        F.count_if(F.col("call_type") == "click").alias("clicks"),
        F.count_if(F.col("call_type") == "view").alias("views"),
    )
    return aggregates.floor_quantiles(m, "feed", "seconds", {"median_s": 0.5, "p90_s": 0.9}).join(totals, F.col("feed").eqNullSafe(F.col("_feed"))).drop("_feed")


def audio_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of each feed and local day: how many, and the first twenty in order."""
    m = messages(spark, sf).select("feed", day_key(F.col("at")).alias("day"), "at_us", "event_id")
    counts = m.groupBy(F.col("feed").alias("_f"), F.col("day").alias("_d")).agg(F.count("*").alias("n"))
    first = m.withColumn("_r", F.row_number().over(Window.partitionBy("feed", "day").orderBy("at_us", "event_id"))).filter("_r <= 20")
    clips = first.groupBy("feed", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "event_id"))), lambda x: x.event_id.cast("string")), ",").alias("first_clips"))
    return clips.join(counts, (F.col("feed") == F.col("_f")) & (F.col("day") == F.col("_d"))).drop("_f", "_d")


def late_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Per feed the messages over 90 s after its first, and its rate; the first comes from an aggregate joined back."""
    m = messages(spark, sf).select("feed", "at_us")
    spans = m.groupBy(F.col("feed").alias("_f")).agg(F.min("at_us").alias("first_us"))
    rate = F.round(F.count("*") / F.greatest(F.lit(1.0), (F.max("at_us") - F.min("at_us")) / 60e6), 6)
    return m.join(spans, F.col("feed") == F.col("_f")).groupBy("feed").agg(F.count_if(F.col("at_us") - F.col("first_us") > 90_000_000).alias("late"), rate.alias("per_minute"))


def routine_split(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    newest = m.groupBy(F.col("feed").alias("_f")).agg(F.max("at_us").alias("newest"))
    rows = m.join(newest, F.col("feed") == F.col("_f")).withColumn("wire", F.col("k") >= 50)
    return rows.filter("wire OR newest - at_us <= 3600000000").select("event_id", "feed", "wire")


def two_band_ranking(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).filter("call_type = 'error'").select("event_id", "at_us", "k")
    return ordered.two_bands(m, "k", "at_us", "event_id")


def thin_tail(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select("event_id", "at_us")
    return ordered.thin_tail(m, 300, 1 / 3, "at_us", "event_id")


def watch_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = messages(spark, sf).groupBy("unit").agg(F.max("k").alias("heat"), F.max(F.expr(_TIER)).alias("tier"), F.max("at_us").alias("updated"), F.count_if(F.expr("call_type = 'error'")).alias("errors"))
    rank = 100 * (F.col("errors") > 16).cast("int") + 50 * (F.col("tier") >= 3).cast("int") + 10 * F.col("tier") + F.least(F.lit(9.0), F.col("heat") / 10.0)
    return g.withColumn("rank", F.round(rank, 4)).orderBy(F.desc("rank"), F.desc("updated"), "unit").limit(10)


def flow_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts per feed against the hour before: arrivals, departures and suspect jumps."""
    m = messages(spark, sf).withColumn("hour", F.floor(F.col("at_us") / (60 * MINUTE)).cast("bigint"))
    h = m.groupBy("feed", "hour").agg(F.count("*").alias("n"))
    h = h.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("feed").orderBy("hour"))).filter("delta IS NOT NULL")
    return aggregates.flow_totals(h, "feed", "delta", ignore=1, suspect=4)


def curve_corr(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select(day_key(F.col("at")).alias("day"), hour_key(F.col("at")).alias("hour")).filter("hour NOT IN ('20', '21', '22')")
    counts = m.groupBy("day", "hour").agg(F.count("*").alias("n"))
    fullest = counts.groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "day").limit(2)
    return aggregates.curve_correlation(counts, fullest, "day", "hour", "n")


def dispatch_gap(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.first_to_later(messages(spark, sf), "unit", "at_us", F.col("call_type") == "signup", F.col("call_type") == "purchase", limit=600 * MINUTE, family=F.col("feed"))


def hourly_curve(spark: SparkSession, sf: str) -> DataFrame:
    per_day = messages(spark, sf).groupBy(day_key(F.col("at")).alias("day"), hour_key(F.col("at")).alias("hour")).agg(F.count("*").alias("n"))
    return per_day.groupBy("hour").agg(F.count("*").alias("days"), F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").alias("most"))


_LOCAL = """timezone('America/New_York', timezone('UTC', "at"))"""

QUERIES: dict[str, Query] = {
    "burst_sessions": Query(
        burst_sessions, ("W1", "W6"),
        _BURSTS + " SELECT feed, CAST(burst AS BIGINT) AS burst, count(*) AS n, min(at_us) AS from_us, max(at_us) AS to_us, round(sum(value), 4) AS total FROM bursts GROUP BY feed, burst",
    ),
    "ranked_groups": Query(ranked_groups, ("G4", "G5", "O3"), _RANKED),
    "density_by_feed": Query(
        lambda s, d: messages(s, d).groupBy(F.coalesce("feed", F.lit("unknown")).alias("feed")).agg(F.count("*").alias("n"), F.max("at_us").alias("newest_us"), F.min("at_us").alias("oldest_us"), F.countDistinct("unit").alias("units")),
        ("G1", "G13", "G14", "G16", "G17"),
        f"WITH {M} SELECT coalesce(feed, 'unknown') AS feed, count(*) AS n, max(at_us) AS newest_us, min(at_us) AS oldest_us, count(DISTINCT unit) AS units FROM messages GROUP BY 1",
    ),
    "mode_first_wins": Query(
        lambda s, d: aggregates.mode_first(messages(s, d), "unit", "call_type", ["at_us", "event_id"]), ("G2",),
        f"""WITH {M}, c AS (SELECT unit, call_type, count(*) AS n, min(at_us) AS f FROM messages GROUP BY 1, 2)
        SELECT unit, call_type, n FROM c QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, f) = 1""",
    ),
    "scene_fold": Query(
        lambda s, d: messages(s, d).groupBy("unit").agg(
            F.array_join(F.array_sort(F.collect_set("call_type")), ",").alias("kinds"), F.min("at_us").alias("from_us"), F.max("at_us").alias("to_us"),
            F.round(F.min_by("lat", F.struct("at_us", "event_id")), 6).alias("lat"), F.round(F.min_by("lon", F.struct("at_us", "event_id")), 6).alias("lon"),
        ), ("G3",),
        f"""WITH {M} SELECT unit, array_to_string(list_sort(list(DISTINCT call_type)), ',') AS kinds, min(at_us) AS from_us, max(at_us) AS to_us,
        round(arg_min(lat, at_us), 6) AS lat, round(arg_min(lon, at_us), 6) AS lon FROM messages GROUP BY unit""",
    ),
    "session_summary": Query(
        session_summary, ("G6",),
        f"""WITH {M}, s AS (SELECT *, CAST(floor(value) AS BIGINT) AS seconds FROM messages)
        SELECT feed, count(*) AS total, count(*) FILTER (call_type = 'error') AS stale,
               list_sort(list(seconds))[CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1] AS median_s,
               list_sort(list(seconds))[CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1] AS p90_s,
               max(seconds) AS longest_s, count(*) FILTER (call_type = 'click') AS clicks, count(*) FILTER (call_type = 'view') AS views
        FROM s GROUP BY feed""",
    ),
    "activity_totals": Query(
        lambda s, d: messages(s, d).groupBy("call_type").agg(F.count("*").alias("n"), F.sum("k").alias("people"), F.count_if(F.expr("k >= 66")).alias("measured"), F.count_if(F.expr("k BETWEEN 33 AND 65")).alias("modelled"), F.count_if(F.expr("k < 33")).alias("relative")),
        ("G7",),
        f"""WITH {M} SELECT call_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS people, count(*) FILTER (k >= 66) AS measured,
        count(*) FILTER (k BETWEEN 33 AND 65) AS modelled, count(*) FILTER (k < 33) AS relative FROM messages GROUP BY 1""",
    ),
    "call_stats": Query(
        lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.char_length("text") < 40).alias("short"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars")),
        (), "SELECT role, count(*) AS n, count(*) FILTER (length(text) < 40) AS short, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY role",
    ),
    "fleet_level": Query(
        lambda s, d: aggregates.fleet_level(
            messages(s, d).groupBy(F.floor(F.col("at_us") / (1440 * MINUTE)).alias("day"), "feed").agg(F.count("*").alias("n")).select("day", F.when(F.col("n") >= 26, "high").when(F.col("n") >= 22, "watch").otherwise("normal").alias("level")), "day", "level"),
        ("G11",),
        f"""WITH {M}, f AS (SELECT at_us // 86400000000 AS day, feed, count(*) AS n FROM messages GROUP BY 1, 2),
        c AS (SELECT day, count(*) FILTER (n >= 26) AS high, count(*) FILTER (n >= 22 AND n < 26) AS watch FROM f GROUP BY day)
        SELECT day, high, watch, CASE WHEN high >= 3 THEN 'high' WHEN high + watch >= 4 THEN 'watch' ELSE 'normal' END AS level FROM c""",
    ),
    "audio_by_day": Query(
        audio_by_day, ("G15",),
        f"""WITH {M} SELECT feed, strftime({_LOCAL}, '%Y-%m-%d') AS day, count(*) AS n,
        array_to_string(list(event_id ORDER BY at_us, event_id)[1:20], ',') AS first_clips FROM messages GROUP BY 1, 2""",
    ),
    "inter_arrival_gap": Query(
        lambda s, d: aggregates.largest_gap(messages(s, d), "feed", "at_us", "event_id"), ("G19",),
        f"""WITH {M}, g AS (SELECT feed, at_us - lag(at_us) OVER (PARTITION BY feed ORDER BY at_us, event_id) AS gap FROM messages)
        SELECT feed, max(gap) AS longest_gap, count(gap) AS gaps FROM g GROUP BY feed""",
    ),
    "hourly_curve": Query(
        hourly_curve, ("G19",),
        f"""WITH {M}, p AS (SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, strftime({_LOCAL}, '%H') AS hour, count(*) AS n FROM messages GROUP BY 1, 2)
        SELECT hour, count(*) AS days, round(avg(n), 6) AS mean_n, max(n) AS most FROM p GROUP BY hour""",
    ),
    "curve_corr": Query(
        curve_corr, ("G19",),
        f"""WITH {M}, p AS (SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, strftime({_LOCAL}, '%H') AS hour, count(*) AS n FROM messages GROUP BY 1, 2),
        k AS (SELECT * FROM p WHERE hour NOT IN ('20', '21', '22')), d AS (SELECT day, row_number() OVER (ORDER BY sum(n) DESC, day) AS r FROM k GROUP BY day),
        j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT k.* FROM k JOIN d USING (day) WHERE r = 1) a FULL JOIN (SELECT k.* FROM k JOIN d USING (day) WHERE r = 2) b USING (hour))
        SELECT round(corr(x, y), 6) AS r, count(*) AS hours FROM j""",
    ),
    "dispatch_to_field_gap": Query(
        dispatch_gap, ("G19",),
        f"""WITH {M}, f AS (SELECT unit, min(at_us) FILTER (call_type = 'signup') AS first_us FROM messages GROUP BY unit),
        l AS (SELECT m.unit, any_value(m.feed) AS feed, min(m.at_us) - any_value(first_us) AS gap FROM messages m JOIN f USING (unit) WHERE call_type = 'purchase' AND m.at_us > first_us GROUP BY m.unit)
        SELECT feed AS family, count(*) AS n, list_sort(list(gap))[CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1] AS median_gap FROM l WHERE gap <= 36000000000 GROUP BY feed""",
    ),
    "flow_totals": Query(
        flow_delta, ("G8",),
        f"""WITH {M}, h AS (SELECT feed, at_us // 3600000000 AS hour, count(*) AS n FROM messages GROUP BY 1, 2),
        d AS (SELECT feed, n - lag(n) OVER (PARTITION BY feed ORDER BY hour) AS delta FROM h)
        SELECT feed, CAST(sum(CASE WHEN delta > 1 AND delta < 4 THEN delta ELSE 0 END) AS BIGINT) AS arrivals, CAST(sum(CASE WHEN delta < -1 AND delta > -4 THEN -delta ELSE 0 END) AS BIGINT) AS departures,
               count(*) FILTER (abs(delta) >= 4) AS suspect, CAST(sum(CASE WHEN abs(delta) > 1 AND abs(delta) < 4 THEN delta ELSE 0 END) AS BIGINT) AS net
        FROM d WHERE delta IS NOT NULL GROUP BY feed""",
    ),
    "last_n_per_source": Query(
        lambda s, d: ordered.last_n(messages(s, d).select("feed", "event_id", "at_us"), ["feed"], [F.desc("at_us"), F.desc("event_id")], 3), ("W3", "W4", "B23"),
        f"WITH {M} SELECT feed, event_id, at_us, row_number() OVER (PARTITION BY feed ORDER BY at_us DESC, event_id DESC) AS back FROM messages QUALIFY back <= 3",
    ),
    "context_lines": Query(
        lambda s, d: ordered.context_lines(messages(s, d).select("feed", "event_id", "at_us", "call_type"), "feed", ["at_us", "event_id"], "call_type", 3).withColumn("context", F.array_join("context", ",")), ("W4",),
        f"""WITH {M} SELECT feed, event_id, at_us, call_type, coalesce(string_agg(call_type, ',') OVER (PARTITION BY feed ORDER BY at_us, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM messages""",
    ),
    "repeat_rank": Query(
        lambda s, d: messages(s, d).select(F.sha2("unit", 256).alias("who"), "event_id", F.row_number().over(Window.partitionBy("unit").orderBy("at_us", "event_id")).alias("visit"),
                                            F.array_join(F.collect_list(F.col("event_id").cast("string")).over(Window.partitionBy("unit").orderBy("at_us", "event_id").rowsBetween(-5, -1)), ",").alias("prior")), ("W9",),
        f"""WITH {M} SELECT sha256(unit) AS who, event_id, row_number() OVER (PARTITION BY unit ORDER BY at_us, event_id) AS visit,
        coalesce(string_agg(CAST(event_id AS VARCHAR), ',') OVER (PARTITION BY unit ORDER BY at_us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS prior FROM messages""",
    ),
    "rank_upgrade": Query(
        lambda s, d: ordered.highest_so_far(messages(s, d).select("unit", "event_id", "at_us", "call_type", F.expr(_TIER).alias("tier")), "unit", ["at_us", "event_id"], "call_type", "tier", "kind"), ("W10", "ST4"),
        f"""WITH {M}, t AS (SELECT unit, event_id, at_us, call_type, {_TIER} AS tier FROM messages),
        p AS (SELECT *, max(tier) OVER (PARTITION BY unit ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS top FROM t),
        f AS (SELECT *, first_value(CASE WHEN tier = top THEN call_type END) OVER (PARTITION BY unit, top ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS kind0 FROM p)
        SELECT unit, event_id, at_us, call_type, tier, kind0 AS kind FROM f""",
    ),
    "late_joins": Query(
        late_joins, ("W7", "W8"),
        f"""WITH {M}, f AS (SELECT feed, at_us, min(at_us) OVER (PARTITION BY feed) AS first_us FROM messages)
        SELECT feed, count(*) FILTER (at_us - first_us > 90000000) AS late, round(count(*) / greatest(1.0, (max(at_us) - min(at_us)) / CAST(60000000 AS DOUBLE)), 6) AS per_minute FROM f GROUP BY feed""",
    ),
    "legs": Query(
        lambda s, d: ordered.legs(messages(s, d).select("unit", "event_id", "at_us", "call_type"), "unit", ["at_us", "event_id"], F.col("call_type") == "error").groupBy("unit", "leg").agg(F.count("*").alias("n"), F.max("at_us").alias("tip_us")), ("W12",),
        f"""WITH {M}, l AS (SELECT unit, at_us, sum(CASE WHEN call_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM messages)
        SELECT unit, CAST(leg AS BIGINT) AS leg, count(*) AS n, max(at_us) AS tip_us FROM l GROUP BY unit, leg HAVING count(*) > 1""",
    ),
    "beat_order": Query(
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("place"), (F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))).alias("is_first"), (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("is_last")), ("W15",),
        """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first,
        turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations""",
    ),
    "two_band_ranking": Query(
        two_band_ranking, ("O4",),
        f"""WITH {M}, r AS (SELECT event_id, at_us, k, max(k) OVER () AS best FROM messages WHERE call_type = 'error' AND k > 0)
        SELECT event_id, at_us, k, k >= best * 0.7 AS close, row_number() OVER (ORDER BY CASE WHEN k >= best * 0.7 THEN 0 ELSE 1 END, CASE WHEN k < best * 0.7 THEN -k END NULLS FIRST, at_us DESC, event_id) AS place FROM r""",
    ),
    "thin_tail": Query(
        thin_tail, ("O5",),
        f"""WITH {M}, r AS (SELECT event_id, at_us, row_number() OVER (ORDER BY at_us DESC, event_id DESC) - 1 AS i, count(*) OVER () AS n FROM messages)
        SELECT event_id, at_us FROM r WHERE n <= 300 OR i < 100 OR (i - 100) IN (SELECT CAST(floor(g * CAST((SELECT max(n) - 100 FROM r) AS DOUBLE) / 200) AS BIGINT) FROM range(200) t(g))""",
    ),
    "line_selection": Query(
        lambda s, d: ordered.last_n(messages(s, d).select("unit", "event_id", "at_us", "k"), ["unit"], [F.when(F.col("k") >= 80, 0).otherwise(1), F.desc("k"), F.col("event_id")], 5).drop("back"), (),
        f"WITH {M} SELECT unit, event_id, at_us, k FROM messages QUALIFY row_number() OVER (PARTITION BY unit ORDER BY CASE WHEN k >= 80 THEN 0 ELSE 1 END, k DESC, event_id) <= 5",
    ),
    "budget_pack": Query(
        lambda s, d: ordered.running_pack(table(s, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("chars")).filter("chars IS NOT NULL"), ["conv_id"], "chars", [F.col("turn"), F.col("chars")], 1500), (),
        "SELECT conv_id, turn, length(text) AS chars, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, length(text) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations WHERE text IS NOT NULL QUALIFY used <= 1500",
    ),
    "probe_priority": Query(
        lambda s, d: aggregates.zone_topk(messages(s, d).select("event_id", "lat", "lon", "k"), (F.col("lat") > 42.4) & (F.col("lon") > -71.0), F.round(F.log10(F.col("k") + 1.0), 6), "event_id", 120, 0.6), ("O9",),
        f"""WITH {M}, r AS (SELECT event_id, k, lat > CAST(42.4 AS DOUBLE) AND lon > CAST(-71.0 AS DOUBLE) AS inside, round(log10(k + 1.0), 6) AS weight FROM messages),
        p AS (SELECT *, row_number() OVER (PARTITION BY inside ORDER BY weight DESC, event_id) AS place FROM r)
        SELECT event_id, inside, weight FROM p WHERE place <= CASE WHEN inside THEN 72 ELSE 48 END""",
    ),
    "watch_rank": Query(
        watch_rank, ("O11",),
        f"""WITH {M}, g AS (SELECT unit, max(k) AS heat, max({_TIER}) AS tier, max(at_us) AS updated, count(*) FILTER (call_type = 'error') AS errors FROM messages GROUP BY unit)
        SELECT *, round(CASE WHEN errors > 16 THEN 100 ELSE 0 END + CASE WHEN tier >= 3 THEN 50 ELSE 0 END + 10 * tier + least(CAST(9 AS DOUBLE), heat / CAST(10 AS DOUBLE)), 4) AS rank FROM g ORDER BY rank DESC, updated DESC, unit LIMIT 10""",
    ),
    "board_order": Query(
        lambda s, d: ordered.last_n(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.unix_micros("o_orderdate").alias("at_us")), ["o_custkey"],
                                    [F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1), F.desc("at_us"), F.col("o_orderkey")], 10), (),
        """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) AS at_us, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END,
        CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS back FROM orders QUALIFY back <= 10""",
    ),
    "routine_split": Query(
        routine_split, ("A6",),
        f"WITH {M}, n AS (SELECT *, max(at_us) OVER (PARTITION BY feed) AS newest FROM messages) SELECT event_id, feed, k >= 50 AS wire FROM n WHERE k >= 50 OR newest - at_us <= 3600000000",
    ),
    "machine_report": Query(
        lambda s, d: messages(s, d).groupBy("unit").agg(F.max_by("call_type", F.struct("at_us", "event_id")).alias("latest"), F.max("at_us").alias("at_us"), F.countDistinct("feed").alias("feeds"), F.count_if(F.expr("k > 50")).alias("live")), ("A3",),
        f"WITH {M} SELECT unit, arg_max(call_type, at_us) AS latest, max(at_us) AS at_us, count(DISTINCT feed) AS feeds, count(*) FILTER (k > 50) AS live FROM messages GROUP BY unit",
    ),
}
