"""Incidents from a live stream: keyed state, event-time timers, one town (or all of them) a key.

A message joins the incident one of its units is on, else one at its venue, else one at its address
or near it; else it starts one if it says enough, else it stays loose.  An incident is cleared by
a line that says so or 90 minutes after its last one, and archived three hours later.

Messages wait until the watermark has passed them and are then heard in order of (time, id), so the
outcome depends on neither batches nor restarts.  Waiting messages, incidents and the unit of each
are maps in the state store: a batch reads a key's open incidents and writes those that changed.
Messages wait in slots of time, many in one value, and one slot at a time is heard.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

MINUTE = 60_000
# Fixed values of the rules: how long ago and how far away an incident may be to be joined.
UNIT_MS, MOST_UNITS = 45 * MINUTE, 24
PLACE_MS, REACH_M = 120 * MINUTE, {"exact": 200.0, "approx": 90.0}
VENUE_MS, VENUE_UNTYPED_MS = 25 * MINUTE, 4 * MINUTE
CLEAR_MS, ARCHIVE_MS = 90 * MINUTE, 180 * MINUTE

#: Time in one slot of waiting messages, and how many are sorted into slots at once.
SLOT_MS, AT_ONCE = 10 * MINUTE, 50_000

MESSAGE = "feed string, units array<string>, call_type string, role string, clear boolean, inherited boolean, lat double, lon double, precision string, matched string, venue string, spot string"
SCENE = "first_ms bigint, last_ms bigint, ended_ms bigint, feed string, kind string, lat double, lon double, precision string, matched string, venue string, spot string, units array<string>, n int"
OUT = "town string, event string, message string, incident string, how string, at_ms bigint, kind string, messages int, units int"
_MESSAGE, _SCENE, _OUT = ([c.split(" ")[0] for c in schema.split(", ")] for schema in (MESSAGE, SCENE, OUT))
_WAITING = "messages array<struct<" + ", ".join(f"{n}: {k}" for n, k in (c.split(" ") for c in f"at_ms bigint, message string, {MESSAGE}".split(", "))) + ">>"
_BETTER = {None: 0, "weak": 1, "approx": 2, "exact": 3}


def _metres(a: dict, b: dict) -> float:
    mid = math.radians((a["lat"] + b["lat"]) / 2)
    return 111194.92664455873 * math.hypot(b["lat"] - a["lat"], (b["lon"] - a["lon"]) * math.cos(mid))


class Town:
    """The open incidents of one key while a batch is heard; ``changed`` and ``gone`` say what to write back."""

    def __init__(self, scenes: dict[str, dict], units: dict[str, str], ranks: dict[str, int]):
        self.scenes, self.units, self.ranks = scenes, units, ranks
        self.changed: set[str] = set()
        self.gone: set[str] = set()
        self.moved_units: set[str] = set()
        self.out: list[dict] = []
        # Incidents that are not cleared, in order of their begin, and times at which one may be due, not after it is.
        self.open = dict(sorted(((n, s) for n, s in scenes.items() if s["ended_ms"] is None), key=lambda x: (x[1]["first_ms"], x[0])))
        self.wakes = [(self.due(s), n) for n, s in scenes.items()]
        heapify(self.wakes)

    def _tell(self, event: str, name: str | None, at: int, **more) -> None:
        s = self.scenes.get(name, {})
        self.out.append({"event": event, "incident": name, "at_ms": at, "kind": s.get("kind"), "messages": s.get("n"), "units": len(s["units"]) if s else None} | more)

    def end(self, name: str, at: int) -> None:
        """Clear an incident and free its units."""
        scene = self.scenes[name]
        scene["ended_ms"] = at
        del self.open[name]
        self.changed.add(name)
        for u in scene["units"]:
            if self.units.get(u) == name:
                del self.units[u]
                self.moved_units.add(u)
        self._tell("cleared", name, at)

    def pass_time(self, now: int) -> None:
        """Clear and archive, in order of time, what is due strictly before ``now``."""
        while self.wakes and self.wakes[0][0] < now:
            at, name = heappop(self.wakes)
            if name not in self.scenes:
                continue
            if self.due(self.scenes[name]) > at:
                heappush(self.wakes, (self.due(self.scenes[name]), name))
            elif self.scenes[name]["ended_ms"] is None:
                self.end(name, at)
                heappush(self.wakes, (self.due(self.scenes[name]), name))
            else:
                self._tell("archived", name, at)
                del self.scenes[name]
                self.gone.add(name)

    @staticmethod
    def due(scene: dict) -> int:
        return scene["last_ms"] + CLEAR_MS if scene["ended_ms"] is None else scene["ended_ms"] + ARCHIVE_MS

    def _by_unit(self, m: dict) -> str | None:
        for u in m["units"]:
            name = self.units.get(u)
            if name and m["at_ms"] - self.scenes[name]["last_ms"] < UNIT_MS and len(self.scenes[name]["units"]) < MOST_UNITS:
                clash = m["venue"] and self.scenes[name]["venue"] == m["venue"] and self._elsewhere(self.scenes[name], m)
                return None if clash else name
        return None

    @staticmethod
    def _elsewhere(scene: dict, m: dict) -> bool:
        """Whether both say where in the venue they are, and differ."""
        return bool(scene["spot"] and m["spot"] and scene["spot"] != m["spot"])

    def _by_venue(self, m: dict) -> str | None:
        best = None
        for name, s in self.open.items():
            age = m["at_ms"] - s["last_ms"]
            fits = age < VENUE_MS and s["kind"] in (None, m["call_type"]) if m["call_type"] else age < VENUE_UNTYPED_MS and s["feed"] == m["feed"]
            if s["venue"] == m["venue"] and fits and not self._elsewhere(s, m):
                score = (bool(m["spot"]) and s["spot"] == m["spot"], s["last_ms"])
                best = (score, name) if best is None or score > best[0] else best
        return best[1] if best else None

    def _by_place(self, m: dict) -> tuple[str | None, str]:
        best = None
        for name, s in self.open.items():
            if s["precision"] == "exact" and not s["venue"] and m["at_ms"] - s["last_ms"] < PLACE_MS:
                if s["matched"] and s["matched"] == m["matched"]:
                    return name, "address"
                far = _metres(s, m)
                if far < REACH_M[m["precision"]] and (best is None or far < best[0]):
                    best = (far, name)
        return (best[1], "near") if best else (None, "")

    def hear(self, m: dict) -> None:
        """Put one message where it belongs."""
        self.pass_time(m["at_ms"])
        m = m | {"units": [u.lower() for u in m["units"] or []]}
        placed = m["lat"] is not None and m["lon"] is not None
        if not placed:
            m |= {"precision": None, "venue": None, "spot": None, "matched": None}
        name, how = self._by_unit(m), "unit"
        if name is None and placed and m["precision"] in REACH_M:
            name, how = (self._by_venue(m), "venue") if m["venue"] else self._by_place(m)
        if name is None and self._starts(m, placed):
            name, how = f"i-{m['message']}", "new"
            self.scenes[name] = {"first_ms": m["at_ms"], "last_ms": m["at_ms"], "ended_ms": None, "units": [], "n": 0} | {c: None for c in ("kind", "spot")} | {c: m[c] for c in ("feed", "lat", "lon", "precision", "matched", "venue")}
            self.open.pop(name, None)
            self.open[name] = self.scenes[name]
            self.gone.discard(name)
            heappush(self.wakes, (self.due(self.scenes[name]), name))
        if name is None:
            self._tell("message", None, m["at_ms"], message=m["message"], how="loose")
            return
        scene = self.scenes[name]
        self._take(name, scene, m)
        self._tell("message", name, m["at_ms"], message=m["message"], how=how)
        if m["clear"]:
            self.end(name, m["at_ms"])

    @staticmethod
    def _starts(m: dict, placed: bool) -> bool:
        told = bool(m["units"]) and m["call_type"] is not None
        if not placed:
            return told and m["role"] != "field" and not m["clear"]
        vague = m["precision"] == "weak" and not told
        idle = m["venue"] and m["call_type"] is None and not (m["units"] and m["spot"])
        return not (vague or idle or m["inherited"])

    def _take(self, name: str, scene: dict, m: dict) -> None:
        scene["last_ms"], scene["n"] = m["at_ms"], scene["n"] + 1
        rank = lambda kind: self.ranks.get(kind, 0)
        if m["call_type"] and (scene["kind"] is None or rank(m["call_type"]) > rank(scene["kind"])):
            scene["kind"] = m["call_type"]
        if _BETTER.get(m["precision"], 0) > _BETTER.get(scene["precision"], 0):
            scene |= {c: m[c] for c in ("lat", "lon", "precision", "matched")}
        if m["venue"] and m["venue"] == scene["venue"] and m["spot"]:
            scene["spot"] = m["spot"]
        scene["units"] += [u for u in dict.fromkeys(m["units"]) if u not in scene["units"]]
        for u in m["units"]:
            self.units[u] = name
            self.moved_units.add(u)
        self.changed.add(name)


class _Correlator(StatefulProcessor):
    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint, chunk bigint", _WAITING)
        self.chunks = handle.getValueState("chunks", "chunks bigint")
        self.scenes = handle.getMapState("scenes", "incident string", SCENE)
        self.units = handle.getMapState("units", "unit string", "incident string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, slots, n = None, {}, 0
        chunk = self.chunks.get()[0] if self.chunks.exists() else 0
        for r in rows:
            slots.setdefault(r.at_ms // SLOT_MS, []).append((r.at_ms, r.message, *(r[c] for c in _MESSAGE)))
            first = r.at_ms if first is None else min(first, r.at_ms)
            n += 1
            if n % AT_ONCE == 0:
                self._wait(slots, chunk)
                slots, chunk = {}, chunk + 1
        if first is not None:
            self._wait(slots, chunk)
            self.chunks.update((chunk + 1,))
            self.handle.registerTimer(first + 1)
        return iter(())

    def _wait(self, slots: dict[int, list[tuple]], chunk: int) -> None:
        for slot, messages in slots.items():
            self.waiting.updateValue((slot, chunk), (messages,))

    def _due(self, keys: list[tuple[int, int]], now: int) -> tuple[list[tuple], int | None]:
        """Messages of a slot before ``now``, each once, in order; the others wait on, and the time of their first."""
        waiting = {}
        for k in keys:
            for m in self.waiting.getValue(k)[0]:
                waiting[m[0], m[1]] = tuple(m)
            self.waiting.removeKey(k)
        later = [m for (at, _), m in waiting.items() if at >= now]
        if later:
            self.waiting.updateValue(keys[-1], (later,))
        return sorted((m for (at, _), m in waiting.items() if at < now), key=lambda m: m[:2]), min((m[0] for m in later), default=None)

    @staticmethod
    def _told(town: Town, key: tuple) -> Iterable[Row]:
        told, town.out = town.out, []
        return (Row(**{c: row.get(c) for c in _OUT} | {"town": key[0]}) for row in told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        slots: dict[int, list[tuple[int, int]]] = {}
        for k in sorted(tuple(k) for k in self.waiting.keys()):
            slots.setdefault(k[0], []).append(k)
        scenes = {k[0]: dict(zip(_SCENE, v)) | {"units": list(v[_SCENE.index("units")])} for k, v in self.scenes.iterator()}
        town = Town(scenes, {k[0]: v[0] for k, v in self.units.iterator()}, self.ranks)
        wakes = [slot * SLOT_MS + 1 for slot in slots if slot * SLOT_MS >= now]
        for slot in [slot for slot in slots if slot * SLOT_MS < now]:
            due, later = self._due(slots[slot], now)
            for m in due:
                town.hear(dict(zip(("at_ms", "message", *_MESSAGE), m)))
            if later is not None:
                wakes.append(later + 1)
            yield from self._told(town, key)
        town.pass_time(now)
        for name in town.changed - town.gone:
            self.scenes.updateValue((name,), tuple(scenes[name][c] for c in _SCENE))
        for name in town.gone:
            if self.scenes.containsKey((name,)):
                self.scenes.removeKey((name,))
        for u in town.moved_units:
            if u in town.units:
                self.units.updateValue((u,), (town.units[u],))
            elif self.units.containsKey((u,)):
                self.units.removeKey((u,))
        if wake := min(wakes + [town.due(s) + 1 for s in scenes.values()], default=None):
            self.handle.registerTimer(max(wake, now + 1))
        yield from self._told(town, key)

    def close(self) -> None:
        pass


def incidents(messages: DataFrame, late: str = "10 minutes", ranks: dict[str, int] | None = None) -> DataFrame:
    """A row per message (event 'message'), cleared and archived incident, from a stream.

    ``messages`` has town, message (an id), at, and the columns of MESSAGE: units in any case, role
    'field' or another, whether the line clears its incident, whether its place is inherited from
    earlier talk, precision 'exact', 'approx' or 'weak', a venue and the spot in it.  ``ranks``: an
    incident takes the kind of highest rank that is said on it.

    A message that comes twice while it waits counts once; one later than ``late`` is dropped.  Null
    times or ids are dropped, null towns are a town.  Towns are the unit of parallel work; one key for all makes
    units and places global.  Start it under :func:`beaconlake.streaming.replay.keyed_state`.
    """
    rows = messages.filter("at IS NOT NULL AND message IS NOT NULL").withWatermark("at", late)
    rows = rows.select("town", "message", "at", F.unix_millis("at").alias("at_ms"), *_MESSAGE)
    return rows.groupBy("town").transformWithState(_Correlator(ranks or {}), OUT, "append", "eventTime")
