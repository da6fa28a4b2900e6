"""Queries of extraction, classification and severity over the calls that messages stand for.

Every event becomes one line of radio talk, of a dozen shapes, about invented streets.  The view is
one SQL text that both engines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.functions import geo, scoring
from beaconlake.functions import text as tx
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import messages

STREETS = ("alder", "birchmont", "corvane", "dunmore", "eskdale", "farrow", "glenhurst", "harlow", "ivyton", "juniper")
SUFFIXES = ("street", "road", "avenue", "lane", "square")
_LINES = (
    "'engine 5 respond to ' || addr || ' for a working fire'",
    "'we have a possible stabbing at ' || street || ' and ' || street2",
    "'ladder 7 on scene, no fire at ' || addr",
    "'strike a second alarm for ' || addr",
    "'we do not need a third alarm on ' || street",
    "'shots fired, one party shot in the leg, ' || addr",
    "'car 12 traffic stop on route 9, black honda, two occupants'",
    "'medical, unresponsive party, ' || addr || ', ambulance 3 respond'",
    "'test test test'",
    "'caller says someone may have a gun near ' || street",
    "'report of a crash, pedestrian struck at ' || street || ' and ' || street2",
    "'bomb squad and dive team to the ' || street || ' bridge, i am advised it is clear'",
)


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"CASE CAST({index} AS INT) {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))} END"


_tens = "CAST(floor(event_id / 10.0) AS BIGINT)"
_PARTS = {
    "addr": f"CAST(event_id % 900 + 1 AS STRING) || ' ' || {_pick(STREETS, 'event_id % 10')} || ' ' || {_pick(SUFFIXES, f'{_tens} % 5')}",
    "street": f"{_pick(STREETS, 'event_id % 10')} || ' ' || {_pick(SUFFIXES, f'{_tens} % 5')}",
    "street2": f"{_pick(STREETS, '(event_id + 3) % 10')} || ' ' || {_pick(SUFFIXES, f'({_tens} + 1) % 5')}",
}
_TEXT = f"CASE CAST((event_id * 7 + k) % {len(_LINES)} AS INT) {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_LINES))} END"
CALLS_SQL = f"{M}, parts AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM messages), calls AS (SELECT *, {_TEXT} AS text FROM parts)"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """messages with addr, street, street2 and text.

    The made-up columns come out of a generator of one row, so that the optimiser does not write their
    long expressions into every later use.
    """
    parts = messages(spark, sf).select("*", F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in _PARTS.items()]))))
    return parts.select("*", F.explode(F.array(F.expr(_TEXT))).alias("text"))


# Rules of our own: (label, pattern, priority), the first that matches counts.
CALL_TYPES = [
    ("structure fire", "working fire|fully involved|(?:second|third) alarm", "high"),
    ("weapons", "shots fired|gun|stabbing|knife", "high"),
    ("grave medical", "unresponsive|not breathing|cardiac", "high"),
    ("collision", "crash|collision|pedestrian struck", "normal"),
    ("traffic stop", "traffic stop", "low"),
    ("medical", "medical|ambulance", "normal"),
    ("service", "dive team|bomb squad", "normal"),
]
_SFX = "(?:street|road|avenue|lane|square)"
_ADDRESS, _CROSS, _STREET = f"([0-9]{{1,5}} [a-z]+ {_SFX})", f"([a-z]+ {_SFX}) and ([a-z]+ {_SFX})", f"([a-z]+ {_SFX})"
_ALARM, _NEGATED = r"(second|third|fourth|fifth|multiple) alarm", r"\b(no|not|negative|disregard|never)\b[^.!?]*$"
_DISPATCH, _FIELD = r"\b(respond|proceed to|strike)\b", r"\b(we have|we do|i am|on scene)\b"
#: Suffixes as they are folded in address keys.
FOLDED = {"street": "st", "road": "rd", "avenue": "ave", "lane": "ln", "square": "sq"}


def _folded(c: Column) -> Column:
    for long, short in FOLDED.items():
        c = F.regexp_replace(c, f" {long}$", f" {short}")
    return c


def _folded_sql(c: str) -> str:
    for long, short in FOLDED.items():
        c = f"regexp_replace({c}, ' {long}$', ' {short}')"
    return c


def alarm_level(text: Column) -> Column:
    """2 to 5 for a struck alarm, 0 for none or one that the 60 characters before it deny."""
    at = F.regexp_instr(text, F.lit(_ALARM))
    before = F.substring(text, F.greatest(at - 60, F.lit(1)), F.least(at - 1, F.lit(60)))
    word = F.regexp_extract(text, _ALARM, 1)
    level = F.when(word.isin("second", "multiple"), 2).when(word == "third", 3).when(word == "fourth", 4).when(word == "fifth", 5).otherwise(0)
    return F.when(before.rlike(_NEGATED), 0).otherwise(level)


_ALARM_SQL = rf"""CASE WHEN NOT regexp_matches(text, '{_ALARM}') OR regexp_matches(right(regexp_extract(text, '^(.*?)(?:{_ALARM})', 1), 60), '{_NEGATED}') THEN 0
  ELSE CASE regexp_extract(text, '{_ALARM}', 1) WHEN 'second' THEN 2 WHEN 'multiple' THEN 2 WHEN 'third' THEN 3 WHEN 'fourth' THEN 4 WHEN 'fifth' THEN 5 END END"""


def extracted(df: DataFrame) -> DataFrame:
    """The fields of a line: units, call_type, priority, place by the cascade address, corner, street, route; address_key, alarm, role."""
    t = F.col("text")
    found = lambda pattern, group=1: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    units = F.transform(F.regexp_extract_all(t, F.lit("(?:engine|ladder|car|ambulance) [0-9]+"), F.lit(0)), lambda u: F.concat(F.upper(F.substring(u, 1, 1)), F.regexp_extract(u, "[0-9]+", 0)))
    corner = F.when(F.regexp_extract(t, _CROSS, 1) != "", F.concat(F.regexp_extract(t, _CROSS, 1), F.lit(" & "), F.regexp_extract(t, _CROSS, 2)))
    kind = tx.first_match(t, [(a, b) for a, b, _ in CALL_TYPES])
    priority = tx.first_match(t, [(c, b) for _, b, c in CALL_TYPES], "normal")
    dispatch, field = t.rlike(_DISPATCH), t.rlike(_FIELD)
    return df.withColumns(
        {
            "units": F.array_join(F.array_sort(F.array_distinct(units)), ","),
            "kind": kind,
            "priority": priority,
            "place": F.coalesce(found(_ADDRESS), corner, found(_STREET), found("(route [0-9]{1,3})")),
            "address_key": _folded(found(_ADDRESS)),
            "alarm": alarm_level(t),
            "role": F.when(t.rlike(r"\bon scene\b|\bclear\b"), "field").when(dispatch, "dispatch").when(field, "field").otherwise("unknown"),
        }
    )


_CASES = lambda part, default: f"CASE {' '.join(f"WHEN regexp_matches(text, '\\b(?:{p})\\b') THEN '{(label, pri)[part]}'" for label, p, pri in CALL_TYPES)} ELSE {default} END"
EXTRACTED_SQL = rf"""{CALLS_SQL}, extracted AS (SELECT *,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:engine|ladder|car|ambulance) [0-9]+'), lambda u: upper(left(u, 1)) || regexp_extract(u, '[0-9]+')))), ',') AS units,
  {_CASES(0, 'NULL')} AS kind, {_CASES(1, "'normal'")} AS priority,
  coalesce(nullif(regexp_extract(text, '{_ADDRESS}', 1), ''), CASE WHEN regexp_extract(text, '{_CROSS}', 1) <> '' THEN regexp_extract(text, '{_CROSS}', 1) || ' & ' || regexp_extract(text, '{_CROSS}', 2) END,
           nullif(regexp_extract(text, '{_STREET}', 1), ''), nullif(regexp_extract(text, '(route [0-9]{{1,3}})', 1), '')) AS place,
  {_folded_sql(f"nullif(regexp_extract(text, '{_ADDRESS}', 1), '')")} AS address_key, {_ALARM_SQL} AS alarm,
  CASE WHEN regexp_matches(text, '\bon scene\b|\bclear\b') THEN 'field' WHEN regexp_matches(text, '{_DISPATCH}') THEN 'dispatch' WHEN regexp_matches(text, '{_FIELD}') THEN 'field' ELSE 'unknown' END AS role FROM calls)"""


def extracted_calls(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(calls(spark, sf)).select("event_id", "units", "kind", "priority", "place", "address_key", "alarm", "role")


# Rules of our own: what a line may be about, how grave, and whether it needs company.
THREATS = [
    tx.Rule("shots", "shots fired|gunfire", 3), tx.Rule("shot", "(?:party|person|victim) shot", 3), tx.Rule("gun", "gun|pistol|rifle", 2, True), tx.Rule("blade", "stabbing|stabbed|knife", 3),
    tx.Rule("fire", "working fire|fully involved", 2), tx.Rule("smoke", "smoke|burning", 1), tx.Rule("alarm", "(?:second|third|fourth|fifth) alarm", 3), tx.Rule("mayday", "mayday", 3),
    tx.Rule("down", "unresponsive|not breathing", 2), tx.Rule("cardiac", "cardiac|cpr", 2), tx.Rule("struck", "pedestrian struck|struck by", 2), tx.Rule("crash", "crash|collision", 1),
    tx.Rule("fight", "fight|assault", 1), tx.Rule("pursuit", "pursuit|fleeing", 2), tx.Rule("hostage", "hostage|barricaded", 3), tx.Rule("bomb", "bomb|explosive", 3, True),
    tx.Rule("gas", "gas leak|carbon monoxide", 2), tx.Rule("water", "in the water|drowning", 2), tx.Rule("jumper", "jumper", 2), tx.Rule("missing", "missing", 1, True),
    tx.Rule("wires", "wires down", 1), tx.Rule("collapse", "collapse", 3), tx.Rule("evacuate", "evacuat(?:e|ing)", 2), tx.Rule("stop", "traffic stop", 0),
]
SPECIALISTS = [tx.Rule("bomb_squad", "bomb squad", 3), tx.Rule("dive_team", "dive team", 2), tx.Rule("swat", "swat|tactical", 3), tx.Rule("hazmat", "hazmat", 2), tx.Rule("homicide", "homicide", 3), tx.Rule("negotiator", "negotiator", 3), tx.Rule("rescue", "technical rescue", 2), tx.Rule("helicopter", "helicopter", 1)]
NEGATION, HEDGE = "no|not|negative|unfounded", "possible|possibly|may|caller says|reports? of"


def threat_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Signals, special units, tier, whether it is only hearsay, and the reasons in words."""
    found = tx.signals(F.col("text"), THREATS, NEGATION, HEDGE)
    teams = F.array_compact(F.array(*[F.when(F.col("text").rlike(tx.bounded(r.pattern)), F.struct(F.lit(r.id).alias("id"), F.lit(r.tier).alias("tier"))) for r in SPECIALISTS]))
    d = calls(spark, sf).select("event_id", "text").withColumn("found", found).withColumn("teams", teams)
    firm = F.exists("found", lambda s: ~s.soft) | (F.size("teams") > 0)
    d = d.withColumn("weighed", F.transform("found", lambda s: F.struct(s.id.alias("id"), s.hedged.alias("hedged"), F.greatest(F.lit(0), s.tier - F.when(s.soft & ~firm, 1).otherwise(0)).alias("tier"))))
    tier = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform("weighed", lambda s: s.tier)), F.lit(0)), F.coalesce(F.array_max(F.transform("teams", lambda s: s.tier)), F.lit(0)))
    d = d.withColumn("tier", tier).withColumn("top", F.filter("weighed", lambda s: s.tier == F.col("tier")))
    why = F.transform("weighed", lambda s: F.concat(s.id, F.when(s.hedged, " (unconfirmed)").otherwise("")))
    return d.select("event_id", "tier", ((F.size("top") > 0) & F.forall("top", lambda s: s.hedged)).alias("hedged"), (F.size("teams") > 0).alias("self_evident"), F.array_join(F.concat(why, F.transform("teams", lambda s: s.id)), ", ").alias("why"))


def _threat_sql() -> str:
    before = lambda r: f"right(regexp_extract(text, '^(.*?)\\b(?:{r.pattern})\\b', 1), 60)"
    hit = lambda r: f"(regexp_matches(text, '\\b(?:{r.pattern})\\b') AND NOT regexp_matches({before(r)}, '\\b(?:{NEGATION})\\b')) AS {r.id}, regexp_matches({before(r)}, '\\b(?:{HEDGE})\\b') AS {r.id}_h"
    firm = " OR ".join([r.id for r in THREATS if not r.soft] + [r.id for r in SPECIALISTS])
    weigh = ", ".join(f"CASE WHEN {r.id} THEN {f'CASE WHEN firm THEN {r.tier} ELSE {r.tier - 1} END' if r.soft else r.tier} END AS {r.id}_t" for r in THREATS)
    tier = f"greatest(0, {', '.join(f'{r.id}_t' for r in THREATS)}, {', '.join(f'CASE WHEN {r.id} THEN {r.tier} END' for r in SPECIALISTS)})"
    why = ", ".join([f"CASE WHEN {r.id} THEN '{r.id}' || CASE WHEN {r.id}_h THEN ' (unconfirmed)' ELSE '' END END" for r in THREATS] + [f"CASE WHEN {r.id} THEN '{r.id}' END" for r in SPECIALISTS])
    return f"""WITH {CALLS_SQL}, s AS (SELECT event_id, text, {', '.join(map(hit, THREATS))}, {', '.join(f"regexp_matches(text, '\\b(?:{r.pattern})\\b') AS {r.id}" for r in SPECIALISTS)} FROM calls),
    f AS (SELECT *, {firm} AS firm FROM s), w AS (SELECT *, {weigh} FROM f), t AS (SELECT *, {tier} AS tier FROM w)
    SELECT event_id, tier, ({' OR '.join(f'coalesce({r.id}_t = tier, false)' for r in THREATS)}) AND NOT ({' OR '.join(f'coalesce({r.id}_t = tier AND NOT {r.id}_h, false)' for r in THREATS)}) AS hedged,
      {' OR '.join(r.id for r in SPECIALISTS)} AS self_evident, concat_ws(', ', {why}) AS why FROM t"""


# Rules of our own: the eighteen kinds of talk, the first that matches counts.
CATEGORIES = [
    ("violence", "shots fired|stabbing|gun|assault|knife"), ("fire", "working fire|alarm|fully involved"), ("medical", "medical|ambulance|unresponsive|cardiac"), ("crash", "crash|collision|struck"),
    ("traffic-stop", "traffic stop"), ("pursuit", "pursuit|fleeing"), ("search", "missing|dive team"), ("hazard", "gas leak|wires down|hazmat"), ("theft", "robbery|larceny|burglary"),
    ("disturbance", "disturbance|fight|domestic"), ("welfare", "well being|welfare"), ("alarm-check", "master box|smoke detector"), ("transport", "transport(?:ing)?"), ("radio-check", "test|radio check"),
]


def categories(spark: SparkSession, sf: str) -> DataFrame:
    t = F.trim("text")
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    numeric = (digits >= 8) & (digits / F.length(F.regexp_replace(t, r"\s", "")) > 0.45)
    label = tx.first_match(t, CATEGORIES)
    kind = (
        F.when(F.length(t) < 13, "unintelligible")
        .when(t.rlike(r"^[\s0-9.,;:\-()]*$") | numeric, "dispatch-admin")
        .when(label.isNotNull(), label)
        .when(t.rlike(r"^(engine|ladder|car) [0-9]+"), "unit-status")
        .when(F.length(t) < 70, "chatter")
        .otherwise("other")
    )
    return calls(spark, sf).groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_CATEGORY_SQL = rf"""WITH {CALLS_SQL}, c AS (SELECT event_id, trim(text) AS t FROM calls)
SELECT CASE WHEN length(t) < 13 THEN 'unintelligible' WHEN regexp_matches(t, '^[\s0-9.,;:\-()]*$') OR (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 8 AND length(regexp_replace(t, '[^0-9]', '', 'g')) / CAST(length(regexp_replace(t, '\s', '', 'g')) AS DOUBLE) > 0.45) THEN 'dispatch-admin'
  {' '.join(f"WHEN regexp_matches(t, '\\b(?:{p})\\b') THEN '{k}'" for k, p in CATEGORIES)} WHEN regexp_matches(t, '^(engine|ladder|car) [0-9]+') THEN 'unit-status' WHEN length(t) < 70 THEN 'chatter' ELSE 'other' END AS category,
  count(*) AS n, min(event_id) AS first_id FROM c GROUP BY 1"""

DAY = 86_400_000_000


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of a scene (the calls of a street and day): what the scores need."""
    t = F.col("text")
    d = extracted(calls(spark, sf)).withColumn("day", F.floor(F.col("at_us") / DAY))
    first = F.min("at_us").over(Window.partitionBy("street", "day"))
    said = lambda pattern: F.count_if(t.rlike(pattern))
    return d.withColumn("late", F.col("at_us") - first > 90_000_000).groupBy("street", "day").agg(
        F.count("*").alias("n"), F.countDistinct("feed").alias("feeds"), F.countDistinct("unit").alias("units"), ((F.max("at_us") - F.min("at_us")) / 60e6).alias("span"), F.max("alarm").alias("alarm"),
        said(r"\bunresponsive\b|\bshot in\b").alias("grave"), said(r"\bshots fired\b|\bstabbing\b").alias("heavy"), said(r"\balarm\b|\bengine\b|\bladder\b").alias("fire_ops"), (said(r"\bno fire\b") > 0).alias("fire_nothing"),
        said(r"\bbomb squad\b|\bdive team\b").alias("specialists"), F.count_if("late").alias("late_units"), F.max(F.when(F.col("priority") == "high", 1).otherwise(0)).alias("high"), F.max(F.when(t.rlike("fire|shots|stabbing"), 3).when(t.rlike("medical|crash"), 2).otherwise(1)).alias("tier"),
        F.min(F.when(t.rlike("possible|caller says"), 1).otherwise(0)).alias("hedged"),
    )


_SCENES_SQL = rf"""{EXTRACTED_SQL}, e AS (SELECT *, at_us // {DAY} AS day, at_us - min(at_us) OVER (PARTITION BY street, at_us // {DAY}) > 90000000 AS late FROM extracted),
scenes AS (SELECT street, day, count(*) AS n, count(DISTINCT feed) AS feeds, count(DISTINCT unit) AS units, (max(at_us) - min(at_us)) / CAST(60000000 AS DOUBLE) AS span, max(alarm) AS alarm,
  count(*) FILTER (regexp_matches(text, '\bunresponsive\b|\bshot in\b')) AS grave, count(*) FILTER (regexp_matches(text, '\bshots fired\b|\bstabbing\b')) AS heavy, count(*) FILTER (regexp_matches(text, '\balarm\b|\bengine\b|\bladder\b')) AS fire_ops,
  count(*) FILTER (regexp_matches(text, '\bno fire\b')) > 0 AS fire_nothing, count(*) FILTER (regexp_matches(text, '\bbomb squad\b|\bdive team\b')) AS specialists, count(*) FILTER (late) AS late_units,
  max(CASE WHEN priority = 'high' THEN 1 ELSE 0 END) AS high, max(CASE WHEN regexp_matches(text, 'fire|shots|stabbing') THEN 3 WHEN regexp_matches(text, 'medical|crash') THEN 2 ELSE 1 END) AS tier,
  min(CASE WHEN regexp_matches(text, 'possible|caller says') THEN 1 ELSE 0 END) AS hedged FROM e GROUP BY street, day)"""


def heat_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    heat = scoring.heat(c("units"), c("n"), c("span"), c("late_units"), c("feeds"), c("alarm"), c("tier"), c("hedged") == 1, c("specialists"), F.lit(0), c("high") == 1)
    return _scenes(spark, sf).select("street", "day", heat.cast("bigint").alias("heat"))


_HEAT_SQL = f"""WITH {_SCENES_SQL} SELECT street, day, CAST(greatest(0, least([50, 62, 80, 100][tier + 1], floor(
  least(30.0, least(14.0, greatest(0, units - 1) * 4.0) + least(10.0, n * 1.5) + least(6.0, n / greatest(1.0, span) * 4)) + least(14, late_units * 5) + least(12, greatest(0, feeds - 1) * 8)
  + least(25, greatest(0, alarm - 1) * 12) + least(10.0, greatest(0.0, (greatest(1.0, span) - 25) / CAST(6 AS DOUBLE))) + [0, 6, 22, 45][tier + 1] * CASE WHEN hedged = 1 THEN CAST(0.7 AS DOUBLE) ELSE 1 END
  + least(10, specialists * 6) + CASE WHEN high = 1 THEN 8 ELSE 0 END + 0.5))) AS BIGINT) AS heat FROM scenes"""


def judged_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence floor of each scene, what a model's score may be beside it, and whether the scene is a major one.

    The model says 4 for high priority and 2 otherwise; a scene without a second feed counts as not verified.
    """
    s = _scenes(spark, sf)
    anomaly = F.when(F.col("n") >= 8, "high").when(F.col("n") >= 5, "watch").otherwise("normal")
    c = F.col
    s = s.withColumn("floor", scoring.severity_floor(c("grave"), c("heavy"), c("tier"), c("n"), c("feeds"), c("units"), c("span"), c("fire_ops"), c("fire_nothing"), anomaly, F.lit("normal")))
    model = F.when(F.col("high") == 1, 4.0).otherwise(2.0)
    s = s.withColumn("settled", scoring.settle(F.col("floor.score"), F.col("floor.heard"), model))
    verified = F.col("feeds") >= 2
    return s.select("street", "day", F.col("floor.score").alias("floor"), F.col("floor.heard").cast("bigint").alias("heard"), F.col("settled").alias("severity"), (F.col("settled") < model).alias("capped"), (verified & (F.col("settled") >= 3)).alias("major"))


_JUDGED_SQL = f"""WITH {_SCENES_SQL}, b AS (SELECT *, CASE WHEN grave > 0 THEN 4.0 WHEN heavy > 0 OR tier >= 3 THEN 3.0 WHEN tier = 2 THEN 2.0 ELSE 1.0 END AS base, CASE WHEN grave > 0 THEN 4 WHEN heavy > 0 OR tier >= 3 THEN 3 ELSE 0 END AS h0, fire_ops >= 2 AND NOT fire_nothing AS burning FROM scenes),
s1 AS (SELECT *, base + CASE WHEN feeds >= 4 THEN 2.0 WHEN feeds = 3 THEN 1.0 WHEN feeds = 2 AND base >= 2 THEN 0.5 ELSE 0 END + CASE WHEN units >= 8 THEN 1.0 WHEN units >= 5 THEN 0.5 ELSE 0 END AS x FROM b),
s2 AS (SELECT *, x + CASE WHEN span >= 45 AND x >= 2 THEN 0.5 ELSE 0 END AS y FROM s1),
s3 AS (SELECT *, CASE WHEN burning THEN CASE WHEN y < 3 THEN 3.0 ELSE y + 0.5 END + CASE WHEN span >= 20 THEN 0.5 ELSE 0 END ELSE y END AS z, CASE WHEN burning THEN greatest(h0, 3) ELSE h0 END AS heard FROM s2),
s4 AS (SELECT *, greatest(0.0, least(5.0, floor((z + CASE WHEN n >= 8 THEN 1.5 WHEN n >= 5 THEN 0.75 ELSE 0 END) * 2 + 0.5) / 2)) AS o FROM s3),
s5 AS (SELECT *, CASE WHEN heard = 0 AND o > 3 THEN 3.0 ELSE o END AS score, CASE WHEN high = 1 THEN 4.0 ELSE 2.0 END AS model FROM s4),
s6 AS (SELECT *, greatest(least(model, least(5.0, score + 1)), heard) AS settled FROM s5)
SELECT street, day, CAST(score AS DOUBLE) AS floor, CAST(heard AS BIGINT) AS heard, CAST(settled AS DOUBLE) AS severity, settled < model AS capped, feeds >= 2 AND settled >= 3 AS major FROM s6"""


def street_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Type, core and consonant skeleton of each street."""
    core = F.regexp_replace("street", f" {_SFX}$", "")
    skeleton = F.concat(F.substring(core, 1, 1), F.regexp_replace(F.substr(core, F.lit(2)), "[aeiouy]", ""))
    return calls(spark, sf).groupBy("street").agg(F.count("*").alias("n")).select("street", F.regexp_extract("street", f"{_SFX}$", 0).alias("type"), core.alias("core"), skeleton.alias("skeleton"), "n")


_SKELETON = "left(core, 1) || regexp_replace(substr(core, 2), '[aeiouy]', '', 'g')"

#: Fixed points of the grid at which lines never tie: invented hospitals.
HOSPITALS = [(42.30, -71.10), (42.36, -71.06), (42.45, -70.95)]
HOSPITAL_M = 200.0


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Usable points, none near a hospital, with their distance (great circle) to the middle of the box and the grade of their precision."""
    m = messages(spark, sf).withColumn("precision", F.when(F.col("k") >= 75, "exact").when(F.col("k") >= 50, "approx").when(F.col("k") >= 25, "weak").otherwise("wide"))
    near = F.lit(False)
    for lat, lon in HOSPITALS:
        near = near | (geo.metres(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= HOSPITAL_M)
    inside = F.col("lat").between(42.2, 42.55) & F.col("lon").between(-71.2, -70.85)
    kept = m.filter(F.col("precision").isin("exact", "approx") & geo.usable(F.col("lat"), F.col("lon")) & inside & ~near)
    return kept.select("event_id", "precision", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(42.375), F.lit(-71.025)), 3).alias("metres"))


_metres_to = lambda lat, lon: f"sqrt(pow((CAST({lon} AS DOUBLE) - lon) * CAST(111194.92664455873 AS DOUBLE) * cos(radians((lat + CAST({lat} AS DOUBLE)) / 2)), 2) + pow((CAST({lat} AS DOUBLE) - lat) * CAST(111194.92664455873 AS DOUBLE), 2))"

QUERIES: dict[str, Query] = {
    "extracted_calls": Query(extracted_calls, ("E1", "F9", "F17", "F18"), f"WITH {EXTRACTED_SQL} SELECT event_id, units, kind, priority, place, address_key, alarm, role FROM extracted"),
    "threat_levels": Query(threat_levels, ("C1", "C2", "C3", "B25"), _threat_sql()),
    "categories": Query(categories, ("C4",), _CATEGORY_SQL),
    "heat_scores": Query(heat_scores, ("C5", "W7", "W8"), _HEAT_SQL),
    "judged_scenes": Query(judged_scenes, ("G12", "C6", "C7", "C12"), _JUDGED_SQL),
    "street_parts": Query(
        street_parts, ("F12",),
        f"WITH {CALLS_SQL}, s AS (SELECT street, regexp_replace(street, ' {_SFX}$', '') AS core, count(*) AS n FROM calls GROUP BY 1, 2) SELECT street, regexp_extract(street, '{_SFX}$') AS type, core, {_SKELETON} AS skeleton, n FROM s",
    ),
    "anchors": Query(
        anchors, ("P4", "P5", "F7", "B1", "B5"),
        f"""WITH {M}, p AS (SELECT *, CASE WHEN k >= 75 THEN 'exact' WHEN k >= 50 THEN 'approx' WHEN k >= 25 THEN 'weak' ELSE 'wide' END AS precision FROM messages)
        SELECT event_id, precision, round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(CAST(42.375 AS DOUBLE) - lat) / 2), 2) + cos(radians(lat)) * cos(radians(CAST(42.375 AS DOUBLE))) * pow(sin(radians(CAST(-71.025 AS DOUBLE) - lon) / 2), 2)))), 3) AS metres
        FROM p WHERE precision IN ('exact', 'approx') AND (lat <> 0 OR lon <> 0) AND lat BETWEEN 42.2 AND 42.55 AND lon BETWEEN -71.2 AND -70.85 AND NOT ({' OR '.join(f'{_metres_to(*h)} <= {HOSPITAL_M}' for h in HOSPITALS)})""",
    ),
}
