"""Queries of the work that a model may do, with a stand-in whose answers follow from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.operators import model
from beaconlake.plans.calls import CALLS_SQL, calls
from beaconlake.plans.core import Query

DAILY = 20


class Script:
    """A provider that answers by rule: right, made up, empty and careless answers among them."""

    def ask(self, task: str, payload: dict) -> dict:
        if task == "verify":
            return {"supported": len(payload["claim"]) % 3 > 0, "quote": payload["lines"][:9], "refutes": ""}
        text = payload["text"]
        n = len(text)
        return {
            "units": [" ".join(text.split(" ")[:2])], "call_type": "fire" if "fire" in text else "unknown", "landmark": "Corvane Hall" if n % 2 else "Quantum Gardens", "town": "N/A" if n % 3 else "Ayr",
            "is_clear": "clear" in text, "is_stop": False, "noise": n % 5 == 0,
        }


def model_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Calls through a model that may answer twenty a day, the freshest, and through rules beyond."""
    k, text = F.col("k"), F.col("text")
    lines = calls(spark, sf).select(
        F.col("event_id").cast("string").alias("message"), "at", F.col("feed").alias("src"), "text", F.when(k % 3 == 0, "Harlow").alias("feed_town"), (text == "test test test").alias("rule_noise"), F.array("unit").alias("rule_units"),
        F.col("call_type").alias("rule_call_type"), text.contains("on scene").alias("rule_clear"), text.contains("traffic stop").alias("rule_stop"), (k % 7 == 0).alias("rule_record"), text.rlike("[0-9]").alias("rule_fact"),
    )
    found = model.extract(lines, Script(), DAILY)
    return found.select("message", F.array_join("units", ",").alias("units"), "call_type", "landmark", "town", "clear", "stop", "noise", "invented", "by", "why")


_EXTRACTION = f"""WITH {CALLS_SQL}, marked AS (SELECT *, text = 'test test test' AS quiet, length(text) AS n, strftime(timezone('America/New_York', timezone('UTC', "at")), '%Y-%m-%d') AS day FROM calls),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day, quiet ORDER BY date_trunc('minute', "at") DESC, "at" DESC, CAST(event_id AS VARCHAR)) AS r FROM marked),
m AS (SELECT *, NOT quiet AND r <= {DAILY} AS model FROM ranked)
SELECT CAST(event_id AS VARCHAR) AS message, CASE WHEN model THEN upper(regexp_replace(regexp_extract(text, '^[^ ]* ?[^ ]*'), '[ -]', '', 'g')) ELSE unit END AS units,
  CASE WHEN model THEN CASE WHEN contains(text, 'fire') THEN 'fire' END ELSE call_type END AS call_type, CASE WHEN model AND n % 2 = 1 AND contains(text, 'corvane') THEN 'Corvane Hall' END AS landmark,
  CASE WHEN k % 3 = 0 THEN 'Harlow' WHEN model AND n % 3 = 0 THEN 'Ayr' END AS town, CASE WHEN model THEN contains(text, 'clear') AND k % 7 <> 0 ELSE contains(text, 'on scene') END AS clear, contains(text, 'traffic stop') AS stop,
  CASE WHEN model THEN n % 5 = 0 AND NOT regexp_matches(text, '[0-9]') ELSE quiet END AS noise, model AND (n % 2 = 0 OR NOT contains(text, 'corvane')) AS invented,
  CASE WHEN model THEN 'model' WHEN quiet THEN 'noise' ELSE 'rules' END AS by, CASE WHEN model THEN NULL WHEN quiet THEN 'noise' ELSE 'budget' END AS why FROM m"""

CLAIMS = [("stabbing", "stabbing"), ("working fire", "fire"), ("pedestrian", "struck|crash")]


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines by half days and four channels, and what was written about the half day after."""
    c = calls(spark, sf).withColumn("slot", F.floor(F.col("at_us") / (12 * 3_600_000_000)))
    channel = F.concat(F.lit("F"), F.col("event_id") % 4)
    lines = c.filter("k < 12").select(F.col("slot").alias("run"), channel.alias("feed"), "at", "text")
    k = F.col("k")
    written = c.filter("k >= 60").select(
        F.col("slot").alias("run"), F.concat(F.lit("s"), F.col("event_id")).alias("id"), F.concat("text", F.when(k % 4 == 0, ", Confirmed").otherwise("")).alias("headline"), F.col("street").alias("summary"), F.upper("call_type").alias("type"),
        F.when(k % 2 == 0, "high").otherwise("urgent").alias("priority"), F.when(k % 5 == 0, "Confirmed").when(k % 5 == 1, "certain").otherwise("unclear").alias("confidence"), F.concat(F.lit("s"), F.col("event_id") - 1).alias("updates"), F.lit("nowhere").alias("related"),
        F.array(F.lower(channel), F.lit("f9")).alias("feeds"),
    )
    return written, lines, written.select("id")


def disposed_situations(spark: SparkSession, sf: str) -> DataFrame:
    """What was written about half days, cut down to what their lines bear out, and held unless a second model stands it up."""
    written, lines, board = _runs(spark, sf)
    cut = model.disposed(written, lines, board, CLAIMS)
    return model.verified(cut, lines, [Script()]).select("run", "id", "headline", "type", "priority", "confidence", "updates", "related", F.array_join("feeds", ",").alias("feeds"), "trimmed", "verified", "held", "held_why")


def _disposed_sql() -> str:
    flags = "".join(f", bool_or(regexp_matches(lower(text), '{e}')) AS s{i + 1}" for i, (_, e) in enumerate(CLAIMS))
    missing = ", ".join(f"CASE WHEN regexp_matches(whole, '{c}') AND NOT coalesce(s{i + 1}, false) THEN '{c}' END" for i, (c, _) in enumerate(CLAIMS))
    return f"""WITH {CALLS_SQL}, c AS (SELECT *, CAST(floor(at_us / 43200000000.0) AS BIGINT) AS run FROM calls),
    l AS (SELECT run, list(DISTINCT 'f' || (event_id % 4)) AS heard, bool_or(regexp_matches(lower(text), '\\bconfirm(?:s|ed)?\\b')) AS s0{flags} FROM c WHERE k < 12 GROUP BY run),
    w AS (SELECT c.run, 's' || event_id AS id, text || CASE WHEN k % 4 = 0 THEN ', Confirmed' ELSE '' END AS full_head, text, street, lower(call_type) AS type, k, 's' || (event_id - 1) AS up, 'f' || (event_id % 4) AS feed, l.* EXCLUDE (run), l.run IS NOT NULL AS lines,
      lower(full_head || ' ' || street) AS whole, coalesce(s0, false) AS said FROM c LEFT JOIN l USING (run) WHERE k >= 60),
    d AS (SELECT *, CASE WHEN said THEN full_head ELSE text END AS headline, list_filter([{missing}], lambda x: x IS NOT NULL) AS missing, NOT said AND (k % 4 = 0 OR k % 5 = 0) AS trimmed FROM w),
    e AS (SELECT *, len(missing) > 0 AS bare, lines AND length(headline || ' ' || street) % 3 > 0 AS verified FROM d)
    SELECT run, id, headline, type, CASE WHEN NOT bare AND k % 2 = 0 THEN 'high' ELSE 'normal' END AS priority,
      CASE WHEN NOT verified OR bare OR k % 5 > 1 THEN 'unclear' WHEN k % 5 = 0 AND said THEN 'confirmed' ELSE 'reported' END AS confidence, CASE WHEN up IN (SELECT id FROM w) THEN up END AS updates, CAST(NULL AS VARCHAR) AS related,
      CASE WHEN coalesce(list_contains(heard, feed), false) THEN feed ELSE '' END AS feeds, trimmed, verified, NOT verified OR bare AS held,
      CASE WHEN bare THEN 'no line supports: ' || array_to_string(missing, ', ') WHEN NOT lines THEN 'no lines behind this claim' WHEN NOT verified THEN 'not stood up: no supporting line' END AS held_why FROM e"""


QUERIES: dict[str, Query] = {
    "model_extraction": Query(model_extraction, ("E3", "E4", "B17"), _EXTRACTION),
    "disposed_situations": Query(disposed_situations, ("C11", "C13"), _disposed_sql()),
}
