"""Queries of personal data: only masked texts and hashes come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions import personal, spoken
from beaconlake.plans.calls import CALLS_SQL, calls
from beaconlake.plans.core import Query
from beaconlake.sources.tables import table

KINDS = tuple(personal.EXTRACTORS)
_DIGIT = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "niner")
# Every line gets something personal, some two that overlap.
_SAID = "text || CASE event_id % 6 WHEN 0 THEN ' dob ' || (event_id % 12 + 1) || '/' || (event_id % 28 + 1) || '/1980' WHEN 1 THEN ' license number S' || (10000000 + event_id) WHEN 2 THEN ' call 617-555-' || (1000 + event_id % 9000) WHEN 3 THEN ' plate ' || (100 + event_id % 900) || ' AB' || (event_id % 10) WHEN 4 THEN ' last name Corvane' ELSE ' license 617 555-1234 ' || event_id END"


def personal_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with how much of each kind was found, keys to link by and a hash of the masked text."""
    d = table(spark, sf, "documents")
    made = d.select("doc_id", F.explode(F.array(personal.found(F.col("text")))).alias("m")).select("doc_id", "m.rest", *(F.col(f"m.{kind}").alias(f"k_{kind}") for kind in KINDS))
    every = F.array_join(F.array_sort(F.concat(*(f"k_{k}" for k in KINDS))), ",")
    return made.select("doc_id", *(F.size(f"k_{k}").alias(f"n_{k}") for k in KINDS), F.sha2(every, 256).alias("keys_sha256"), F.sha2("rest", 256).alias("masked_sha256"))


def personal_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of talk, masked, with the keys of what was in them."""
    rows = calls(spark, sf).select("event_id", F.explode(F.array(F.expr(_SAID))).alias("said"))
    made = rows.select("event_id", F.explode(F.array(personal.found(F.col("said"), "beacon"))).alias("m"))
    return made.select("event_id", F.col("m.rest").alias("masked"), F.array_join(F.concat(*(f"m.{kind}" for kind in KINDS)), ",").alias("keys"))


def _masked_sql(column: str, rows: str, carried: str, salt: str) -> str:
    """One step for each extractor, each on what the last left."""
    steps, last = [f"s0 AS (SELECT {carried}, coalesce({column}, '') AS rest FROM {rows})"], "s0"
    for i, (kind, pattern) in enumerate(personal.EXTRACTORS.items(), 1):
        value = f"left(sha256('{salt}' || upper(regexp_replace(v, '[^A-Za-z0-9]', '', 'g'))), 16)"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (rest), list_transform(regexp_extract_all(rest, '{pattern}'), lambda v: {value}) AS k_{kind}, regexp_replace(rest, '{pattern}', '[{kind}]', 'g') AS rest FROM {last})")
        last = f"s{i}"
    return ", ".join(steps) + f", masked AS (SELECT * FROM {last})"


_ALL = " || ".join(f"k_{k}" for k in KINDS)


def spelled_plates(spark: SparkSession, sf: str) -> DataFrame:
    """Plates that are spelled out: what they spell is known by its hash, the talk has a tag in its place."""
    digit = F.array(*map(F.lit, _DIGIT))
    say = lambda d: F.get(digit, (F.floor(F.col("event_id") / d) % 10).cast("int"))
    said = F.concat(F.col("text"), F.lit(" comes back to adam "), say(1), F.lit(", victor "), say(10), F.lit(" "), say(100), F.when(F.col("event_id") % 2 == 0, " x ray").otherwise(" out"))
    rows = calls(spark, sf).select("event_id", F.explode(F.array(said)).alias("said"))
    rest, keys = personal.masked_spelled(F.col("said"))
    runs = F.array_join(F.transform(spoken.spelled_runs(F.substring_index("said", " comes back to ", -1)), lambda r: F.concat_ws("/", r["used"], r["phonetic"], r["spoken"])), ",")
    return rows.select("event_id", F.element_at(keys, -1).alias("plate_key"), F.regexp_extract(rest, r"comes back to (.*)$", 1).alias("masked"), runs.alias("runs"))


_TENS = lambda d: f"(event_id // {d}) % 10"
QUERIES: dict[str, Query] = {
    "personal_masked": Query(
        personal_masked, ("F15", "F16"),
        f"WITH {_masked_sql('text', 'documents', 'doc_id', '')} SELECT doc_id, {', '.join(f'len(k_{k}) AS n_{k}' for k in KINDS)}, sha256(array_to_string(list_sort({_ALL}), ',')) AS keys_sha256, sha256(rest) AS masked_sha256 FROM masked",
    ),
    "personal_lines": Query(
        personal_lines, ("F15", "F16"),
        f"WITH {CALLS_SQL}, said AS (SELECT event_id, {_SAID} AS said FROM calls), {_masked_sql('said', 'said', 'event_id', 'beacon')} SELECT event_id, rest AS masked, array_to_string({_ALL}, ',') AS keys FROM masked",
    ),
    "spelled_plates": Query(
        spelled_plates, ("F14", "F15"),
        f"""WITH {CALLS_SQL} SELECT event_id, left(sha256('A' || {_TENS(1)} || 'V' || {_TENS(10)} || {_TENS(100)} || CASE WHEN event_id % 2 = 0 THEN 'X' ELSE '' END), 16) AS plate_key,
        CASE WHEN event_id % 2 = 0 THEN '[spelled]' ELSE '[spelled] out' END AS masked, CASE WHEN event_id % 2 = 0 THEN '6/3/6' ELSE '5/2/5' END AS runs FROM calls""",
    ),
}
