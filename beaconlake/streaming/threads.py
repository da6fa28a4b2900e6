"""Situations over time: reports threaded into what is on the board, and alerts for what is new on it.

:func:`reconcile` is a batch step over two tables, the board and the reports of a run; a stream
calls it for every micro-batch.  What an editor decided wins over links, links over places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import geo
from beaconlake.operators import joins
from beaconlake.operators.spaced import spaced

LINK_MS, LINK_M = 3 * 3_600_000, 3000.0
MATCH_MS, MATCH_M = 45 * 60_000, 250.0
QUIET_MS, DROP_MS = 20 * 60_000, 40 * 60_000
RULE_MS = 7 * 86_400_000
REARM_MS, FLOOR_MS, STALE_MS = 6 * 3_600_000, 4_000, 180_000
SOUND_CHUNK_MS, DAY_MS = 3_600_000, 86_400_000
BOARD = "id string, kind string, headline string, lat double, lon double, priority string, status string, feeds array<string>, first_ms bigint, updated_ms bigint, beats int"


def latest_rules(log: DataFrame, now_ms: int) -> DataFrame:
    """The rule in force for each handle of an append-only log (seq, at_ms, handle, action, target).

    The latest entry of a handle counts; 'undo' lifts what was there, and rules end after seven days.
    """
    w = Window.partitionBy("handle").orderBy(F.desc("seq"))
    last = log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last.filter((F.col("action") != "undo") & (F.col("at_ms") >= now_ms - RULE_MS))


def threaded(board: DataFrame, reports: DataFrame, rules: DataFrame, now_ms: int) -> DataFrame:
    """Every report with the situation it belongs to (parent, null for a new one) and how it was found.

    ``reports``: report (an id), kind, headline, lat, lon, priority, feeds, updates, related (ids of
    situations).  Rules by report id: 'merge' forces a target, followed over redirects; 'split'
    without a target keeps a report alone, with one keeps it from that situation.
    """
    merges = rules.filter("action = 'merge'").select(F.col("handle").alias("source"), "target")
    forced = joins.follow_redirects(merges, 8).select(F.col("source").alias("_f"), F.col("target").alias("forced"))
    splits = rules.filter("action = 'split'").select(F.col("handle").alias("_s"), F.coalesce("target", F.lit("*")).alias("barred"))
    r = reports.join(forced, F.col("report") == F.col("_f"), "left").join(splits, F.col("report") == F.col("_s"), "left").drop("_f", "_s")
    on = board.select(F.col("id").alias("_id"), F.col("kind").alias("_kind"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("status").alias("_status"), (F.lit(now_ms) - F.col("updated_ms")).alias("_age"))
    allowed = (F.col("barred").isNull() | (F.col("barred") != "*")) & (F.col("barred").isNull() | (F.col("barred") != F.col("_id")))
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))

    def by(handle: str, how: str, rank: int, holds: Column) -> DataFrame:
        met = r.join(on, F.col(handle) == F.col("_id")).filter(allowed & holds)
        return met.select("report", F.col("_id").alias("parent"), F.lit(how).alias("how"), F.lit(rank).alias("_rank"), F.lit(0.0).alias("_far"))

    close = F.col("_age").between(0, LINK_MS) & F.coalesce(far <= LINK_M, F.lit(True))
    links = [by("forced", "forced", 0, F.lit(True)), by("updates", "update", 1, close), by("related", "related", 2, close)]
    live = on.filter((F.col("_status") != "closed") & F.col("_age").between(0, MATCH_MS))
    pairs = joins.near_pairs(r.select("report", "kind", "barred", "lat", "lon"), live.select("_id", "_kind", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")), ["report", "kind", "barred"], ["_id", "_kind"], MATCH_M)
    same = pairs.filter((F.lower("kind") == F.lower("_kind")) & allowed).select("report", F.col("_id").alias("parent"), F.lit("place").alias("how"), F.lit(3).alias("_rank"), F.col("metres").alias("_far"))
    found = links[0].unionByName(links[1]).unionByName(links[2]).unionByName(same)
    best = joins.nearest(found, "report", ["_rank", "_far", "parent"]).select(F.col("report").alias("_r"), "parent", "how")
    return reports.join(best, F.col("report") == F.col("_r"), "left").drop("_r").withColumn("how", F.coalesce("how", F.lit("new")))


def reconcile(board: DataFrame, reports: DataFrame, rules: DataFrame, now_ms: int) -> DataFrame:
    """The board after a run, with the columns of ``board``.

    A new report opens a situation under an id of its content.  An update retells the story (the
    latest report id last); a forced or related one is only a beat of it.  Priority rises and never
    falls, feeds are united and end at six.  What was not reported for 20 minutes is closed, after 40
    it goes.
    """
    t = threaded(board, reports, rules, now_ms)
    told = F.col("how").isin("update", "place")
    order = F.struct("report")
    news = t.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(
        F.count("*").cast("int").alias("_n"), F.max(F.when(F.col("priority") == "high", 1).otherwise(0)).alias("_high"),
        F.max_by("headline", F.when(told & F.col("headline").isNotNull(), order)).alias("_headline"),
        F.max_by(F.struct("lat", "lon"), F.when(told & F.col("lat").isNotNull() & F.col("lon").isNotNull(), order)).alias("_point"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("feeds")))).alias("_feeds"),
    )
    j = board.join(news, F.col("id") == F.col("_p"), "left")
    touched = F.col("_p").isNotNull()
    kept = j.select(
        "id", "kind", F.coalesce("_headline", "headline").alias("headline"), F.coalesce("_point.lat", "lat").alias("lat"), F.coalesce("_point.lon", "lon").alias("lon"),
        F.when(F.col("_high") == 1, "high").otherwise(F.col("priority")).alias("priority"), F.when(touched, F.when(F.col("status") == "closed", "developing").otherwise(F.col("status"))).otherwise(F.col("status")).alias("status"),
        F.slice(F.array_union("feeds", F.coalesce("_feeds", F.array().cast("array<string>"))), 1, 6).alias("feeds"), "first_ms", F.when(touched, F.lit(now_ms)).otherwise(F.col("updated_ms")).alias("updated_ms"),
        (F.col("beats") + F.coalesce("_n", F.lit(0))).alias("beats"),
    )
    new = t.filter("parent IS NULL").select(
        F.concat(F.lit("n-"), F.substring(F.sha1(F.concat_ws("|", "report", F.coalesce("headline", F.lit("")))), 1, 10)).alias("id"), "kind", "headline", "lat", "lon", "priority", F.lit("developing").alias("status"),
        F.slice(F.array_distinct(F.coalesce("feeds", F.array().cast("array<string>"))), 1, 6).alias("feeds"), F.lit(now_ms).alias("first_ms"), F.lit(now_ms).alias("updated_ms"), F.lit(1).alias("beats"),
    )
    age = F.lit(now_ms) - F.col("updated_ms")
    return kept.unionByName(new).filter(age <= DROP_MS).withColumn("status", F.when(age > QUIET_MS, "closed").otherwise(F.col("status")))


def alerts(boards: DataFrame) -> DataFrame:
    """Cards that are news when they show up: boards (board_ms, alert_key, priority, confidence) in, (alert_key, board_ms, high) out.

    The first board is the backlog and alerts nothing.  A key alerts when it was not seen alerting for
    six hours, the first board counting; cards whose confidence is unclear never do.
    """
    cards = boards.filter(F.coalesce(F.col("confidence") != "unclear", F.lit(True)) & F.col("alert_key").isNotNull())
    cards = cards.groupBy("alert_key", "board_ms").agg(F.max(F.coalesce((F.col("priority") == "high").cast("int"), F.lit(0))).alias("high"))
    first = boards.agg(F.min("board_ms").alias("_primed"))
    fires = spaced(cards, ["alert_key"], "board_ms", REARM_MS)
    fired = cards.join(fires, ["alert_key", "board_ms"]).crossJoin(F.broadcast(first))  # one row
    return fired.filter("board_ms > _primed").drop("_primed")


def sounds(fired: DataFrame, mode: str = "all") -> DataFrame:
    """(board_ms, cue) of the boards that sound, of those that alert.

    A board sounds if four seconds have passed since the last one that did: 'high' with a high
    card, else 'new'.  Mode 'high' leaves out boards without a high card, 'off' all.
    """
    boards = fired.groupBy("board_ms").agg(F.max("high").alias("_high")).filter({"all": "true", "high": "_high = 1", "off": "false"}[mode])
    heard = spaced(boards, [], "board_ms", FLOOR_MS, SOUND_CHUNK_MS)
    return heard.join(boards, "board_ms").select("board_ms", F.when(F.col("_high") == 1, "high").otherwise("new").alias("cue"))


def stale(polls: DataFrame) -> DataFrame:
    """(poll_ms, since_ms) of the polls that call the feed stale, once an outage.

    ``polls``: poll_ms, ok, board_ms (when the board was made).  A poll is good if it is ok and its board, if dated, is at
    most three minutes old.  A poll that isn't is dark at once if its board tells that it is older, or
    else if the last good poll (the first poll of all, before any) is over three minutes past.
    """
    old = F.coalesce(F.col("poll_ms") - F.col("board_ms") > STALE_MS, F.lit(False))
    each = polls.select("poll_ms", F.coalesce("ok", F.lit(False)).alias("_ok"), old.alias("_old")).withColumn("_good", F.col("_ok") & ~F.col("_old")).withColumn("_day", F.floor(F.col("poll_ms") / DAY_MS))
    first = polls.agg(F.min("poll_ms").alias("_first"))
    # The last good poll of the days before comes from one row a day; inside a day it is a window.
    days = each.groupBy("_day").agg(F.max(F.when(F.col("_good"), F.col("poll_ms"))).alias("_last"))
    carried = days.select(F.col("_day").alias("_d"), F.max("_last").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.max(F.when(F.col("_good"), F.col("poll_ms"))).over(Window.partitionBy("_day").orderBy("poll_ms").rangeBetween(Window.unboundedPreceding, -1))
    known = each.withColumn("_here", here).join(carried, F.col("_day") == F.col("_d")).crossJoin(F.broadcast(first))  # one row
    since = F.coalesce("_here", "_carried")
    dark = known.filter(~F.col("_good")).filter(F.col("_old") | (F.col("poll_ms") - F.coalesce(since, "_first") > STALE_MS))
    return dark.groupBy(since.alias("since_ms")).agg(F.min("poll_ms").alias("poll_ms")).select("poll_ms", "since_ms")
