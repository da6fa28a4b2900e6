"""Scenes that are one event heard on two radios: a star-shaped merge in order of time.

A scene takes in later ones whose seed (what it was when it was formed) lies near its own in time
and place; what it took in does not extend its reach, so that a chain of neighbours is not one
event.  Scenes are swept in order inside the stretches of a town in which one begins within the
merge gap of what came before; towns and stretches are the unit of work.  A sweep reads a stretch in
order of time, as far as its seed reaches, and gives a scene on as soon as it has its place, so a task
holds the scenes of a reach, however long the stretch is.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MERGE_MS = 40 * 60_000
SAME_PLACE_M = 150.0
OUT = "town string, scene string, into string"
#: Rows that are given on at once, and entries of lists that come before those of scenes that are gone are thrown out.
ROWS, ENTRIES = 10_000, 4096


def stretches(scenes: DataFrame, gap: int = MERGE_MS) -> DataFrame:
    """``scenes`` with the number of the stretch in its town: a new one begins more than ``gap`` after all earlier ones ended."""
    before = Window.partitionBy("town").orderBy("from_ms", "scene").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.when(F.col("from_ms") - F.max("to_ms").over(before) <= gap, 0).otherwise(1)
    return scenes.withColumn("_s", starts).withColumn("stretch", F.sum("_s").over(Window.partitionBy("town").orderBy("from_ms", "scene").rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def _near(a: dict, b: dict) -> bool:
    gap = max(0, b["from_ms"] - a["to_ms"], a["from_ms"] - b["to_ms"])
    if gap > MERGE_MS:
        return False
    if a["address"] and a["address"] == b["address"]:
        return True
    if None in (a["lat"], a["lon"], b["lat"], b["lon"]):
        return len(a["words"] & b["words"]) >= 2
    mid = math.radians((a["lat"] + b["lat"]) / 2)
    return 111194.92664455873 * math.hypot(b["lat"] - a["lat"], (b["lon"] - a["lon"]) * math.cos(mid)) <= SAME_PLACE_M


#: Width of a place's cell in degrees: a little more than SAME_PLACE_M.
_WIDTH = SAME_PLACE_M / 111194.92664455873 * 1.001


class _Ahead:
    """Scenes that a seed may be near, in order of time, by what they share with it: an address, a cell of places, a word.

    The unseeded are in lists of their own, since they are never taken by their like.  Scenes are read when a seed
    reaches them; what is no longer alive leaves each list that is read, and all lists from time to time.
    """

    def __init__(self, rows: Iterator[dict]):
        self.rows = iter(rows)
        self.following = next(self.rows, None)
        self.read = 0
        self.alive: dict[int, dict] = {}
        self.lists: dict[tuple, list[tuple[int, int]]] = {}
        self.entries, self.most = 0, ENTRIES

    def more(self) -> bool:
        """Read one scene, if there is one."""
        r = self.following
        if r is None:
            return False
        self.following = next(self.rows, None)
        self.alive[self.read] = r
        for key in self._homes(r):
            self.lists.setdefault((bool(r["loose"]), *key), []).append((r["from_ms"], self.read))
            self.entries += 1
        self.read += 1
        if self.entries > self.most:
            self.lists = {key: left for key, held in self.lists.items() if (left := [x for x in held if x[1] in self.alive])}
            self.entries = sum(map(len, self.lists.values()))
            self.most = 2 * self.entries + ENTRIES
        return True

    @staticmethod
    def _lone(r: dict) -> bool:
        return r["lat"] is None or r["lon"] is None

    @staticmethod
    def _step(band: int) -> float:
        """The width in longitude of the cells of a band of latitude, at least SAME_PLACE_M anywhere in it or beside it; near a pole none."""
        top = (max(abs(band), abs(band + 1)) + 1) * _WIDTH
        return _WIDTH / math.cos(math.radians(top)) if top < 89 else math.inf

    def _homes(self, r: dict) -> list[tuple]:
        keys: list[tuple] = [("address", r["address"])] if r["address"] else []
        keys += [("word", w) for w in r["words"]]
        if self._lone(r):
            keys += [("lone", w) for w in r["words"]]
        elif math.isfinite(r["lat"]) and math.isfinite(r["lon"]):
            band = math.floor(r["lat"] / _WIDTH)
            keys.append(("cell", band, math.floor(r["lon"] / self._step(band))))
        return keys

    def _around(self, r: dict) -> list[tuple]:
        keys: list[tuple] = [("address", r["address"])] if r["address"] else []
        keys += [("word" if self._lone(r) else "lone", w) for w in r["words"]]
        if not self._lone(r) and math.isfinite(r["lat"]) and math.isfinite(r["lon"]):
            band = math.floor(r["lat"] / _WIDTH)
            for b in (band - 1, band, band + 1):
                step = self._step(b)
                reach = step if step < math.inf else 0.0
                keys += [("cell", b, c) for c in range(math.floor((r["lon"] - reach) / step), math.floor((r["lon"] + reach) / step) + 1)]
        return keys

    def near(self, seed: dict, loose: bool) -> Iterator[int]:
        """Scenes alive that are near ``seed``, seeded or not, each list in order of time."""
        until = seed["to_ms"] + MERGE_MS
        while self.following is not None and self.following["from_ms"] <= until:
            self.more()
        for key in self._around(seed):
            held = self.lists.get((loose, *key))
            if not held:
                continue
            end = bisect_right(held, (until, self.read))
            held[:end] = left = [x for x in held[:end] if x[1] in self.alive]
            yield from [j for _, j in left if _near(seed, self.alive[j])]


def swept(rows: Iterator[dict]) -> Iterator[tuple[dict, str]]:
    """Each scene of a stretch, given in order of time and name, with the scene that it ends up in.  A loose one (a burst
    without a seed of its own) never takes in another loose one, and where it meets a seeded one it is that scene, with its name and seed."""
    ahead, i = _Ahead(rows), 0
    while i < ahead.read or ahead.more():
        seed = ahead.alive.pop(i, None)
        i += 1
        if seed is None:
            continue
        members = [seed]
        if seed["loose"]:
            first = min(ahead.near(seed, False), default=None)
            if first is None:
                yield seed, seed["scene"]
                continue
            seed = ahead.alive.pop(first)
            members.append(seed)
        for loose in (False, True):
            members += [ahead.alive.pop(j) for j in sorted(set(ahead.near(seed, loose)))]
        for r in members:
            yield r, seed["scene"]


def sweep(rows: list[dict]) -> dict[str, str]:
    """Which scene each scene ends up in, in any order."""
    return {r["scene"]: into for r, into in swept(iter(sorted(rows, key=lambda r: (r["from_ms"], r["scene"]))))}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in batch.to_pylist():
            r["words"] = set(r["words"] or ())
            for c in ("lat", "lon"):
                if r[c] is not None and math.isnan(r[c]):
                    r[c] = None
            yield r


def merged(scenes: DataFrame) -> DataFrame:
    """(town, scene, into) of scenes with town, scene, from_ms, to_ms, lat, lon, address, words (array), loose.

    A null town is a town of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["town", "scene", "into"])
        for _, rows in groupby(_records(batches), key=itemgetter("town", "stretch")):
            for r, into in swept(rows):
                out.append((r["town"], r["scene"], into))
                if len(out) >= ROWS:
                    yield made()
                    out = []
        if out:
            yield made()

    rows = stretches(scenes).select("town", "stretch", "scene", "from_ms", "to_ms", "lat", "lon", "address", "words", "loose")
    return rows.repartition("town", "stretch").sortWithinPartitions("town", "stretch", "from_ms", "scene").mapInArrow(run, OUT)
