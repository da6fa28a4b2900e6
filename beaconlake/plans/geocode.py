"""Where a call is: the town it means, and a cascade from a numbered address down to the middle of the town.

Every step is a join with a dimension of streets; distinct heard names are matched once, not once a call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions import fields, geo
from beaconlake.operators import cache, gazetteer
from beaconlake.operators.streets import FEW, LOOSE_MARGIN, MARGIN, ONLY, POOL, POOL_M, best_of, both_ways, corrected, crossings
from beaconlake.plans.calls import CALLS_SQL, STREETS, SUFFIXES, _pick, calls
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import grid_lat, grid_lon, messages, table

CORNER_M = 800.0
_SFX = "(?:street|road|avenue|lane|square)"
_s_tens = "CAST(floor(s_suppkey / 10.0) AS BIGINT)"
_NAME = f"{_pick(STREETS, 's_suppkey % 10')} || ' ' || {_pick(SUFFIXES, f'{_s_tens} % 5')}"
# What was heard: some names lose a letter, the first among them, some are no name at all; some lines have a number, some a second street.
_CORE = f"regexp_replace(street, ' {_SFX}$', '')"
_HEARD = {
    "core": f"CASE WHEN event_id % 11 = 0 THEN 'zzqx' WHEN event_id % 14 = 0 THEN substr({_CORE}, 2) WHEN event_id % 7 = 0 THEN substr({_CORE}, 1, 2) || substr({_CORE}, 4) ELSE {_CORE} END",
    "type": f"regexp_extract(street, '({_SFX})$', 1)",
    "numbered": "event_id % 3 <> 0",
    "corner": "CASE WHEN event_id % 5 = 0 THEN street2 WHEN event_id % 5 = 1 THEN substr(street2, 1, 1) || substr(street2, 3) END",
    "town": "coalesce(CASE WHEN event_id % 4 = 0 THEN 'town' || CAST(event_id % 7 AS STRING) END, CASE WHEN length(feed) = 6 THEN 'town' || substr(feed, 6) END)",
}


def streets(spark: SparkSession, sf: str) -> DataFrame:
    """Every street of every town, straight from a point on: town, name, core, type, lat, lon, lat2, lon2."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.expr(_NAME).alias("name"), F.concat(F.lit("town"), (F.col("s_suppkey") % 7).cast("string")).alias("town"))
    first = s.groupBy("town", "name").agg(F.min("s_suppkey").alias("id"))
    lat, lon = grid_lat(F.col("id")), grid_lon(F.col("id"))
    ends = (lat + (F.col("id") * 37 % 100 - 50) / F.lit(200.0)).alias("lat2"), (lon + (F.col("id") * 91 % 100 - 50) / F.lit(200.0)).alias("lon2")
    return first.select("town", "name", F.regexp_replace("name", f" {_SFX}$", "").alias("core"), F.regexp_extract("name", f"({_SFX})$", 1).alias("type"), lat.alias("lat"), lon.alias("lon"), *ends)


def street_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Where two streets of a town cross."""
    return crossings(streets(spark, sf)).select("town", "a", "b", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def geocoded(spark: SparkSession, sf: str) -> DataFrame:
    known = streets(spark, sf)
    h = calls(spark, sf).select("event_id", F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in _HEARD.items()]))))
    h = h.withColumn("heard", F.concat_ws(" ", "core", "type"))
    point = lambda p: known.select(F.col("town").alias(f"{p}t"), F.col("name").alias(f"{p}n"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    meant = corrected(h, known).select(F.col("town").alias("_ft"), F.col("core").alias("_fc"), F.col("type").alias("_fy"), "meant", F.col("lat").alias("flat"), F.col("lon").alias("flon"), "sure")
    crossed = both_ways(crossings(known))
    met = crossed.select(F.col("town").alias("xt"), F.col("street").alias("xa"), F.col("other").alias("xb"), F.col("lat").alias("xlat"), F.col("lon").alias("xlon"))
    # A second street that is none, beside a first that is: the street that crosses the first and sounds most like it.
    unknown = h.select("town", F.col("heard").alias("street"), F.col("corner").alias("_c")).filter("_c IS NOT NULL").join(known.select(F.col("town").alias("_kt"), F.col("name").alias("_kn")), (F.col("town") == F.col("_kt")) & (F.col("_c") == F.col("_kn")), "left_anti")
    unknown = unknown.select("town", "street", F.regexp_replace("_c", f" {_SFX}$", "").alias("heard"))
    few = crossed.select("town", "street", F.col("other").alias("name"), F.regexp_replace("other", f" {_SFX}$", "").alias("core"))
    anchor = best_of(unknown, few, ["town", "street"]).select(F.col("town").alias("yt"), F.col("street").alias("ys"), F.col("heard").alias("yh"), F.col("name").alias("anchored"))
    towns = known.groupBy(F.col("town").alias("_ct")).agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"))
    j = h.join(point("a"), (F.col("town") == F.col("at")) & (F.col("heard") == F.col("an")), "left")
    j = j.join(point("b"), (F.col("town") == F.col("bt")) & (F.col("corner") == F.col("bn")), "left")
    j = j.join(meant, (F.col("town") == F.col("_ft")) & (F.col("core") == F.col("_fc")) & (F.col("type") == F.col("_fy")), "left")
    j = j.join(anchor, (F.col("town") == F.col("yt")) & (F.col("an") == F.col("ys")) & F.col("bn").isNull() & (F.regexp_replace("corner", f" {_SFX}$", "") == F.col("yh")), "left")
    j = j.join(met, (F.col("town") == F.col("xt")) & (F.col("an") == F.col("xa")) & (F.coalesce("bn", "anchored") == F.col("xb")), "left").join(towns, F.col("town") == F.col("_ct"), "left")
    apart = geo.metres(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    at = lambda how, precision, name, lat, lon: F.struct(F.lit(how).alias("how"), F.lit(precision).alias("precision"), name.alias("name"), lat.alias("lat"), lon.alias("lon"))
    c = F.col
    hit = F.coalesce(
        F.when(c("numbered") & c("an").isNotNull(), at("address", "exact", c("an"), c("alat"), c("alon"))),
        F.when(c("xb").isNotNull(), at("crossing", "exact", F.concat_ws(" & ", "an", "xb"), c("xlat"), c("xlon"))),
        F.when(apart <= CORNER_M, at("corner", "approx", F.concat_ws(" & ", "an", "bn"), (c("alat") + c("blat")) / 2, (c("alon") + c("blon")) / 2)),
        F.when(c("an").isNotNull(), at("street", "approx", c("an"), c("alat"), c("alon"))),
        F.when(c("sure"), at("corrected", "approx", c("meant"), c("flat"), c("flon"))),
        F.when(~c("sure"), at("cluster", "approx", F.lit(None).cast("string"), c("flat"), c("flon"))),
        F.when(c("_ct").isNotNull(), at("town", "weak", c("town"), c("_clat"), c("_clon"))),
        at("none", None, F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")),
    )
    return j.withColumn("hit", hit).select("event_id", "town", "hit.how", "hit.precision", "hit.name", F.round("hit.lat", 5).alias("lat"), F.round("hit.lon", 5).alias("lon"))


_SKEL = lambda c: f"left({c}, 1) || regexp_replace(substr({c}, 2), '[aeiouy]', '', 'g')"
_D = "CAST({} AS DOUBLE)".format
_M = lambda a, b: f"sqrt(pow(({b}lon - {a}lon) * CAST(111194.92664455873 AS DOUBLE) * cos(radians(({a}lat + {b}lat) / 2)), 2) + pow(({b}lat - {a}lat) * CAST(111194.92664455873 AS DOUBLE), 2))"
_STREETS = f"""k0 AS (SELECT 'town' || (s_suppkey % 7) AS town, {_NAME} AS name, s_suppkey FROM supplier), k1 AS (SELECT town, name, min(s_suppkey) AS id FROM k0 GROUP BY 1, 2),
k2 AS (SELECT *, regexp_replace(name, ' {_SFX}$', '') AS core, regexp_extract(name, '({_SFX})$', 1) AS type, {_D(42.2)} + CAST(id * 7919 % 1000 AS DOUBLE) / {_D(2500)} AS lat, {_D(-71.2)} + CAST(id * 104729 % 1000 AS DOUBLE) / {_D(2500)} AS lon FROM k1),
k AS (SELECT *, lat + (id * 37 % 100 - 50) / {_D(200)} AS lat2, lon + (id * 91 % 100 - 50) / {_D(200)} AS lon2 FROM k2),
x0 AS (SELECT a.town, a.name AS a, b.name AS b, a.lat, a.lon, a.lat2 - a.lat AS ra, a.lon2 - a.lon AS ro, b.lat2 - b.lat AS sa, b.lon2 - b.lon AS so, b.lat - a.lat AS ga, b.lon - a.lon AS go FROM k a JOIN k b ON a.town = b.town AND a.name < b.name),
x1 AS (SELECT *, (ga * so - go * sa) / (ra * so - ro * sa) AS t, (ga * ro - go * ra) / (ra * so - ro * sa) AS u FROM x0 WHERE ra * so - ro * sa <> 0),
x AS (SELECT town, a, b, lat + t * ra AS lat, lon + t * ro AS lon FROM x1 WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""
_COST = f"levenshtein(y.heard, z.core) / {_D('greatest(length(y.heard), length(z.core))')} + {_D(0.8)} * levenshtein({_SKEL('y.heard')}, {_SKEL('z.core')}) / greatest(1, length({_SKEL('y.heard')}))"
_SQL = f"""WITH {CALLS_SQL}, {_STREETS},
h AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _HEARD.items())} FROM calls), hh AS (SELECT *, core || ' ' || type AS heard, regexp_replace(corner, ' {_SFX}$', '') AS corner_core FROM h),
m AS (SELECT d.town, d.core, d.type, k.name AS meant, k.lat, k.lon, levenshtein({_SKEL('d.core')}, {_SKEL('k.core')}) AS bones,
    round(levenshtein(d.core, k.core) / {_D('greatest(length(d.core), length(k.core))')} + {_D(0.5)} * levenshtein({_SKEL('d.core')}, {_SKEL('k.core')}) / greatest(1, length({_SKEL('k.core')})) + CASE WHEN d.type = k.type THEN 0 ELSE {_D(0.3)} END, 6) AS score
  FROM (SELECT DISTINCT town, core, type FROM hh) d JOIN k ON d.town = k.town WHERE levenshtein(d.core, k.core) BETWEEN 1 AND 2),
r AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS p FROM m WINDOW w AS (PARTITION BY town, core, type ORDER BY score, meant)),
c AS (SELECT r.town, r.core, r.type, r.meant, r.lat, r.lon, r.nxt IS NULL OR r.nxt >= r.score * {MARGIN} OR (r.nxt >= r.score * {LOOSE_MARGIN} AND r.bones <= 1) AS sure, count(*) AS pool, bool_and({_M('r.', 'q.')} <= {POOL_M}) AS together, avg(q.lat) AS mlat, avg(q.lon) AS mlon
  FROM r JOIN r q ON q.town = r.town AND q.core = r.core AND q.type = r.type AND q.score <= r.score * {POOL} WHERE r.p = 1 GROUP BY ALL),
f AS (SELECT * FROM c WHERE sure OR (pool > 1 AND together)),
z AS (SELECT town, a AS street, b AS other, lat, lon, regexp_replace(b, ' {_SFX}$', '') AS core FROM x UNION ALL SELECT town, b, a, lat, lon, regexp_replace(a, ' {_SFX}$', '') FROM x),
y AS (SELECT DISTINCT town, heard AS street, corner_core AS heard FROM hh WHERE corner IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.town = hh.town AND k.name = hh.corner)),
yc AS (SELECT y.*, z.other, round({_COST}, 6) AS cost, count(*) OVER (PARTITION BY y.town, y.street, y.heard) AS few FROM y JOIN z ON z.town = y.town AND z.street = y.street),
an AS (SELECT * FROM yc WHERE true QUALIFY row_number() OVER (PARTITION BY town, street, heard ORDER BY cost, other) = 1 AND (cost = 0 OR (length(heard) >= 4 AND cost <= CASE WHEN few > 1 THEN {FEW} ELSE {ONLY} END))),
t AS (SELECT town, avg(lat) AS lat, avg(lon) AS lon FROM k GROUP BY town),
j AS (SELECT hh.*, a.name AS an, a.lat AS alat, a.lon AS alon, b.name AS bn, b.lat AS blat, b.lon AS blon, f.sure, f.meant, CASE WHEN f.sure THEN f.lat ELSE f.mlat END AS flat, CASE WHEN f.sure THEN f.lon ELSE f.mlon END AS flon, z.other AS xb, z.lat AS xlat, z.lon AS xlon, t.town AS ct, t.lat AS clat, t.lon AS clon, {_M('a.', 'b.')} AS apart
  FROM hh LEFT JOIN k a ON hh.town = a.town AND hh.heard = a.name LEFT JOIN k b ON hh.town = b.town AND hh.corner = b.name LEFT JOIN f ON f.town = hh.town AND f.core = hh.core AND f.type = hh.type
  LEFT JOIN an ON an.town = hh.town AND an.street = a.name AND b.name IS NULL AND an.heard = hh.corner_core LEFT JOIN z ON z.town = hh.town AND z.street = a.name AND z.other = coalesce(b.name, an.other) LEFT JOIN t ON t.town = hh.town),
w AS (SELECT *, CASE WHEN numbered AND an IS NOT NULL THEN 'address' WHEN xb IS NOT NULL THEN 'crossing' WHEN apart <= {CORNER_M} THEN 'corner' WHEN an IS NOT NULL THEN 'street' WHEN sure THEN 'corrected' WHEN NOT sure THEN 'cluster' WHEN ct IS NOT NULL THEN 'town' ELSE 'none' END AS how FROM j)
SELECT event_id, town, how, CASE WHEN how IN ('address', 'crossing') THEN 'exact' WHEN how = 'town' THEN 'weak' WHEN how = 'none' THEN NULL ELSE 'approx' END AS precision,
  CASE how WHEN 'address' THEN an WHEN 'crossing' THEN an || ' & ' || xb WHEN 'corner' THEN an || ' & ' || bn WHEN 'street' THEN an WHEN 'corrected' THEN meant WHEN 'town' THEN town END AS name,
  round(CASE how WHEN 'address' THEN alat WHEN 'crossing' THEN xlat WHEN 'corner' THEN (alat + blat) / 2 WHEN 'street' THEN alat WHEN 'corrected' THEN flat WHEN 'cluster' THEN flat WHEN 'town' THEN clat END, 5) AS lat,
  round(CASE how WHEN 'address' THEN alon WHEN 'crossing' THEN xlon WHEN 'corner' THEN (alon + blon) / 2 WHEN 'street' THEN alon WHEN 'corrected' THEN flon WHEN 'cluster' THEN flon WHEN 'town' THEN clon END, 5) AS lon FROM w"""

_FIELDS = {
    "address": "CASE event_id % 8 WHEN 0 THEN addr || ', Ayr, MA' WHEN 1 THEN street WHEN 2 THEN street || ' and ' || street2 WHEN 3 THEN addr WHEN 4 THEN 'null' WHEN 5 THEN addr || ', harlow hill' WHEN 6 THEN street || ', bury, ayr , 02139' ELSE 'ayr, ma' END",
    "street": "CASE event_id % 5 WHEN 0 THEN addr WHEN 1 THEN street WHEN 2 THEN 'N/A' END",
    "cross": "CASE event_id % 7 WHEN 0 THEN street2 WHEN 1 THEN street || ' & ' || street2 WHEN 2 THEN 'x' END",
    "town": "CASE WHEN event_id % 3 = 0 THEN 'Bury' WHEN event_id % 3 = 1 THEN 'unknown' END",
    "sign": "CASE event_id % 4 WHEN 0 THEN unit WHEN 1 THEN CAST(event_id % 1000 AS STRING) WHEN 2 THEN '' END",
}


def field_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Fields as they come, each in its place; and whether the call sign is one to know a unit by."""
    rows = calls(spark, sf).select("event_id", F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in _FIELDS.items()]))))
    c = F.col
    return rows.select("event_id", fields.repaired(c("address"), c("street"), c("cross"), c("town"), F.array(F.lit("ayr"), F.lit("bury"))).alias("r"), fields.strong_unit(c("sign")).alias("strong")).select("event_id", "r.*", "strong")


_said = lambda c: f"CASE WHEN length(trim({c})) >= 3 AND lower(trim({c})) NOT IN ('null', 'none', 'unknown', 'n/a') THEN trim({c}) END"
_two = r"regexp_matches({}, '(?i)\s+(?:and|&|/|at the corner of|corner of)\s+')".format
_num = r"coalesce(regexp_matches({}, '^[0-9]{{1,5}}[A-Za-z]?\s'), false)".format
_REPAIR = f"""WITH {CALLS_SQL}, f AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _FIELDS.items())} FROM calls),
a AS (SELECT event_id, {_said('address')} AS a0, {_said('street')} AS st, {_said('"cross"')} AS x, {_said('town')} AS tn, sign FROM f),
t AS (SELECT *, regexp_extract(a0, '^(.+?)((?: *, *(?:(?i:ma|ayr|bury)|[0-9]{{5}}))*) *$', 1) AS left_, regexp_extract(a0, '^(.+?)((?: *, *(?:(?i:ma|ayr|bury)|[0-9]{{5}}))*) *$', 2) AS tail FROM a),
b AS (SELECT *, nullif(coalesce(left_, ''), '') AS ad, list_filter(list_transform(string_split(coalesce(tail, ''), ','), lambda p: trim(p)), lambda p: lower(p) IN ('ayr', 'bury')) AS found FROM t),
c AS (SELECT *, ad IS NOT NULL AND NOT {_num('ad')} AS bare FROM b), d AS (SELECT *, bare AND {_two('ad')} AND x IS NULL AS corner FROM c),
e AS (SELECT event_id, sign, CASE WHEN corner THEN ad ELSE x END AS x1, CASE WHEN bare AND NOT corner AND st IS NULL THEN ad ELSE st END AS st1, CASE WHEN NOT bare THEN ad END AS ad1, coalesce(tn, found[-1]) AS town FROM d),
g AS (SELECT *, ad1 IS NULL AND {_num('st1')} AS mirrored FROM e), h AS (SELECT *, CASE WHEN mirrored THEN st1 ELSE ad1 END AS ad2, CASE WHEN NOT mirrored THEN st1 END AS st2 FROM g),
i AS (SELECT *, x1 IS NOT NULL AND NOT {_two('x1')} AND st2 IS NULL AND ad2 IS NULL AS single FROM h)
SELECT event_id, ad2 AS address, CASE WHEN single THEN x1 ELSE st2 END AS street, CASE WHEN NOT single THEN x1 END AS "cross", town, coalesce(regexp_matches(sign, '[A-Za-z]') OR length(regexp_replace(sign, '[^0-9]', '', 'g')) >= 3, false) AS strong FROM i"""


def lookup_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups of what events asked for, three times as slow; every fifth name is not to be found."""
    n = F.col("event_id") % 97
    rows = messages(spark, sf).select("event_id", F.concat(F.lit("name "), n).alias("name"), F.floor(F.col("at_us") / 1000 * 3).cast("bigint").alias("at_ms"), (n % 5 > 0).alias("found"))
    return cache.served(rows).select("event_id", "name", "found", "fetched")


_CACHE = f"""WITH RECURSIVE {M}, l AS MATERIALIZED (SELECT event_id, 'name ' || (event_id % 97) AS name, CAST(floor(at_us / 1000.0 * 3) AS BIGINT) AS at_ms, event_id % 97 % 5 > 0 AS found FROM messages),
o AS (SELECT name, found, min(at_ms) AS at_ms FROM l GROUP BY name, found UNION ALL SELECT o.name, o.found, min(l.at_ms) FROM o JOIN l ON l.name = o.name AND l.at_ms >= o.at_ms + CASE WHEN o.found THEN {cache.HIT_MS} ELSE {cache.MISS_MS} END GROUP BY o.name, o.found, o.at_ms)
SELECT event_id, name, found, (name, at_ms) IN (SELECT (name, at_ms) FROM o) AS fetched FROM l"""


_PLACES = f"SELECT DISTINCT name AS alias, 'p-' || name || town AS place, CASE length(name) % 3 WHEN 0 THEN 'hall' WHEN 1 THEN 'rail' ELSE 'road' END AS kind, town FROM k UNION ALL SELECT DISTINCT core, 'c-' || core || town, CASE length(core) % 4 WHEN 0 THEN 'town' WHEN 1 THEN 'rail' ELSE 'hall' END, town FROM k"
_HEARD_TEXT = "CASE WHEN event_id % 6 = 0 THEN text || ' inbound' WHEN event_id % 6 = 1 THEN replace(text, ' street', '') ELSE text END"


def gazetteer_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The place that each call names, with the town of its feed as scope for some."""
    streets(spark, sf).createOrReplaceTempView("beaconlake_streets")
    places = spark.sql(_PLACES.replace("FROM k", "FROM beaconlake_streets")).withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})
    towns = F.when(F.col("event_id") % 3 > 0, F.array(F.concat(F.lit("town"), F.col("event_id") % 7)))
    texts = calls(spark, sf).select(F.col("event_id").alias("id"), F.expr(_HEARD_TEXT).alias("text"), towns.alias("towns"))
    return gazetteer.scan(texts, places).select("id", "alias", "place", "kind", "town", "at", "scoped")


_list = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_SCAN = f"""WITH {CALLS_SQL}, {_STREETS}, places AS ({_PLACES}), t AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN 'town' || (event_id % 7) END AS scope,
  list_filter(string_split(trim(regexp_replace(lower({_HEARD_TEXT}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM calls),
g AS (SELECT id, scope, w, CAST(i AS INT) AS pos, n, array_to_string(w[i + 1 : i + n], ' ') AS alias FROM t, range(0, 40) r(i), range(1, {gazetteer.MOST_WORDS + 1}) q(n) WHERE i + n <= len(w)),
m AS (SELECT g.*, p.place, p.kind, p.town, CASE WHEN pos > 0 THEN w[pos] END AS before, w[pos + n + 1] AS after, n > 1 AND split_part(g.alias, ' ', -1) IN {_list(gazetteer.STREET_TYPES)} AS typed, g.alias IN (SELECT alias FROM places WHERE kind = 'town') AS like_town,
  coalesce(p.town = scope, false) AS scoped FROM g JOIN places p ON p.alias = g.alias),
f AS (SELECT *, CASE WHEN scoped THEN {gazetteer.SCOPED} ELSE 0 END + CASE WHEN kind = 'town' THEN 0 ELSE {gazetteer.NAMED} END + length(alias) AS score FROM m
  WHERE NOT (kind NOT IN ('road', 'town') AND (coalesce(after IN {_list(gazetteer.STREET_TYPES)}, false) OR ((n = 1 OR typed) AND coalesce(regexp_matches(before, '^[0-9]+$'), false))))
  AND NOT (kind = 'rail' AND (typed OR like_town) AND NOT list_has_any(w, ['{"', '".join(gazetteer.RAIL_CUES)}'])) AND NOT (kind = 'town' AND NOT scoped AND scope IS NOT NULL)),
e AS (SELECT *, max(CASE WHEN score >= {gazetteer.ENOUGH} THEN n END) OVER (PARTITION BY id) AS enough FROM f)
SELECT id, alias, place, kind, town, pos AS "at", scoped FROM e WHERE enough IS NULL OR n >= enough QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, n DESC, pos, place) = 1"""

QUERIES: dict[str, Query] = {
    "geocoded": Query(geocoded, ("E7", "E9", "E10", "E11", "B7", "B8", "B10"), _SQL),
    "street_crossings": Query(street_crossings, ("J13", "E9"), f"WITH {_STREETS} SELECT town, a, b, round(lat, 6) AS lat, round(lon, 6) AS lon FROM x"),
    "gazetteer_scan": Query(gazetteer_scan, ("E12", "B6"), _SCAN),
    "lookup_cache": Query(lookup_cache, ("E14",), _CACHE),
    "field_repair": Query(field_repair, ("E6", "F11"), _REPAIR),
}
