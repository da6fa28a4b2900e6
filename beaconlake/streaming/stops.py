"""Traffic stops from a live stream, one state per department.

A patrol unit opens a stop with a cue, later lines of the unit add to it, and a closing phrase ends
it.  A line without a unit joins the one stop open on its feed if it carries something of a stop.
A stop not heard of for 45 minutes is stale: it has no length, only the time it was heard.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONTEXT_MS, STALE_MS = 10 * 60_000, 45 * 60_000
# Rules of our own.
OPENS = re.compile(r"\b(traffic stop|vehicle stop|car stop|pulling over)\b", re.I)
CLOSES = re.compile(r"\b(clear of the stop|sent on (?:his|her|their) way|back in service)\b", re.I)
CONTENT = re.compile(r"\b(plate|registration|licen[cs]e|operator|occupants?|warning|citation|search|backup)\b", re.I)
OUTCOME = [("arrest", r"\b(in custody|under arrest)\b"), ("citation", r"\b(citation|summons)\b"), ("warning", r"\bwarning\b")]
COLOUR, BODY = r"black|white|red|blue|green|gray|silver", r"honda|ford|toyota|sedan|truck|van|suv"
_NUMBER = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
OUT = "dept string, event string, stop string, unit string, feed string, start_ms bigint, end_ms bigint, seconds bigint, heard_for bigint, lines int, inferred int, outcome string, vehicle string, occupants int, plate_key string"


def vehicle(text: str) -> str | None:
    """A make or body with the nearest colour within 28 characters of it."""
    body = re.search(rf"\b({BODY})\b", text, re.I)
    if not body:
        return None
    colours = sorted((abs(m.start() - body.start()), m[1].lower()) for m in re.finditer(rf"\b({COLOUR})\b", text, re.I))
    near = [c for d, c in colours if d <= 28]
    return " ".join([*near[:1], body[1].lower()])


def occupants(text: str) -> int | None:
    m = re.search(r"\b(\d|one|two|three|four|five) (?:occupants?|times|on board)\b", text, re.I)
    return None if not m else int(m[1]) if m[1].isdigit() else _NUMBER[m[1].lower()]


def outcome(text: str) -> str | None:
    return next((name for name, pattern in OUTCOME if re.search(pattern, text, re.I)), None)


def hear(state: dict, m: dict) -> list[dict]:
    """Take in one line (message, at_ms, feed, unit, text, plate_key); the stops it ends, stale ones first."""
    ended = expire(state, m["at_ms"])
    text, stops = m["text"] or "", state["open"]
    stop, by = stops.get(m["unit"]) if m["unit"] else None, "unit"
    if stop is None and not m["unit"]:
        here = [s for s in stops.values() if s["feed"] == m["feed"] and m["at_ms"] - s["last"] <= CONTEXT_MS]
        if len(here) == 1 and (m["plate_key"] or CONTENT.search(text)):
            stop, by = here[0], "context"
    if stop is None:
        if m["unit"] and OPENS.search(text):
            stop = {"stop": f"s-{m['message']}", "unit": m["unit"], "feed": m["feed"], "start": m["at_ms"], "last": m["at_ms"], "lines": 0, "inferred": 0, "outcome": None, "vehicle": None, "occupants": None, "plate_key": None}
            stops[m["unit"]] = stop
        else:
            return ended
    stop["last"] = max(stop["last"], m["at_ms"])
    stop["lines"] += 1
    stop["inferred"] += by == "context"
    stop["outcome"] = outcome(text) or stop["outcome"]
    stop["vehicle"] = stop["vehicle"] or vehicle(text)
    stop["occupants"] = stop["occupants"] if stop["occupants"] is not None else occupants(text)
    stop["plate_key"] = stop["plate_key"] or m["plate_key"]
    if CLOSES.search(text) and stop["lines"] > 1:
        del stops[stop["unit"]]
        ended.append(stop | {"event": "closed", "end": m["at_ms"]})
    return ended


def expire(state: dict, now: int) -> list[dict]:
    """Take out the stops last heard of over STALE_MS ago."""
    old = sorted((s for s in state["open"].values() if now - s["last"] > STALE_MS), key=lambda s: s["stop"])
    for s in old:
        del state["open"][s["unit"]]
    return [s | {"event": "stale", "end": s["last"]} for s in old]


def _row(dept: str, s: dict) -> tuple:
    length = round((s["end"] - s["start"]) / 1000)
    closed = s["event"] == "closed"
    return dept, s["event"], s["stop"], s["unit"], s["feed"], s["start"], s["end"], length if closed else None, None if closed else length, s["lines"], s["inferred"], s["outcome"], s["vehicle"], s["occupants"], s["plate_key"]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state = json.loads(held.get[0]) if held.exists else {"open": {}}
    out: list[tuple] = []
    for batch in batches if not held.hasTimedOut else ():
        for m in batch.sort_values(["at_ms", "message"]).astype(object).where(lambda d: d.notna(), None).to_dict("records"):
            out += [_row(key[0], s) for s in hear(state, m)]
    out += [_row(key[0], s) for s in expire(state, held.getCurrentWatermarkMs())]
    if state["open"]:
        held.update((json.dumps(state),))
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, min(s["last"] for s in state["open"].values()) + STALE_MS + 1))
    elif held.exists:
        held.remove()
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])


def stops(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A row per ended stop of a stream of lines (dept, message, at, feed, unit, text, plate).

    Plates are hashed before they reach any state.
    """
    plate = F.substring(F.sha2(F.upper(F.regexp_replace("plate", "[^A-Za-z0-9]", "")), 256), 1, 16)
    rows = lines.withWatermark("at", late).select("dept", "message", "at", F.unix_millis("at").alias("at_ms"), "feed", "unit", "text", F.when(F.length("plate") > 0, plate).alias("plate_key"))
    return rows.groupBy("dept").applyInPandasWithState(_advance, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def repeats(ended: DataFrame) -> DataFrame:
    """Ended stops with the number of the visit of their hashed plate and the five stops before it."""
    w = Window.partitionBy("plate_key").orderBy("start_ms", "stop")
    prior = F.collect_list("stop").over(w.rowsBetween(-5, -1))
    known = F.col("plate_key").isNotNull()
    return ended.withColumn("visit", F.when(known, F.row_number().over(w)).otherwise(1)).withColumn("prior", F.when(known, prior).otherwise(F.array().cast("array<string>")))
