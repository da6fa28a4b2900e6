"""Misheard names against all pairs, crossings against all pairs of segments."""

from __future__ import annotations

import random

import duckdb
import pytest

from beaconlake.operators import gazetteer, streets


def test_every_name_within_the_edits_is_found(spark):
    rng = random.Random(5)
    letters = "abcde"
    word = lambda n: "".join(rng.choices(letters, k=n))
    names = sorted({word(rng.randrange(1, 10)) for _ in range(150)})
    heard = sorted({(x[1:] or "a") if i % 3 == 0 else x[:-1] + rng.choice(letters) if i % 3 == 1 else rng.choice(letters) + x for i, x in enumerate(names)} | {"", "a"})
    n = spark.createDataFrame([(t, f"{x} st", x) for x in names for t in ("u", "v")], "town string, name string, core string")
    h = spark.createDataFrame([(t, x) for x in heard for t in ("u", "w")], "town string, core string")
    for cap in (1, 2):
        got = {(r.town, r.core, r.name, r.edits) for r in streets.near_names(h, n, ["town"], cap).collect()}
        all_pairs = duckdb.sql(f"SELECT h, n, levenshtein(h, n) AS d FROM (SELECT unnest({heard!r}) AS h) CROSS JOIN (SELECT unnest({names!r}) AS n)").fetchall()
        assert got == {("u", a, f"{b} st", d) for a, b, d in all_pairs if d <= cap}


def test_answers_that_stand_out(spark):
    known = [("t", "harlow street", "harlow", "street", 42.0, -71.0), ("t", "harlew street", "harlew", "street", 42.001, -71.0), ("t", "farrow road", "farrow", "road", 42.5, -71.0), ("t", "corvane lane", "corvane", "lane", 42.2, -71.0)]
    heard = [("t", "orvane", "lane"), ("t", "harliw", "street"), ("t", "zzzzzz", "road"), ("u", "orvane", "lane"), ("t", "corvane", "lane")]
    got = {(r.core, r.type): r for r in streets.corrected(spark.createDataFrame(heard, "town string, core string, type string"), spark.createDataFrame(known, "town string, name string, core string, type string, lat double, lon double")).collect()}
    assert set(got) == {("orvane", "lane"), ("harliw", "street")}
    assert got["orvane", "lane"].meant == "corvane lane" and got["orvane", "lane"].sure
    both = got["harliw", "street"]
    assert (both.meant, both.sure, round(both.lat, 4)) == (None, False, 42.0005)


def test_crossings_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.choice("pq"), f"s{i}", *(rng.uniform(41.95, 42.15) for _ in range(1)), rng.uniform(-71.1, -70.9), rng.uniform(41.95, 42.15), rng.uniform(-71.1, -70.9)) for i in range(80)]
    rows += [("p", "flat", 42.0, -71.1, 42.0, -70.9), ("p", "upright", 41.9, -71.0, 42.2, -71.0), ("p", "level", 42.0, -71.1, 42.0, -70.9), ("q", "point", 42.0, -71.0, 42.0, -71.0), ("p", "edge", 42.0, -71.1, 42.02, -71.0)]

    def meet(a, b):
        (y1, x1, y2, x2), (v1, u1, v2, u2) = a[2:], b[2:]
        across = (y2 - y1) * (u2 - u1) - (x2 - x1) * (v2 - v1)
        if across == 0:
            return None
        t, u = ((v1 - y1) * (u2 - u1) - (u1 - x1) * (v2 - v1)) / across, ((v1 - y1) * (x2 - x1) - (u1 - x1) * (y2 - y1)) / across
        return (round(y1 + t * (y2 - y1), 9), round(x1 + t * (x2 - x1), 9)) if 0 <= t <= 1 and 0 <= u <= 1 else None

    want = {(a[0], a[1], b[1]): p for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (p := meet(a, b))}
    made = streets.crossings(spark.createDataFrame(rows, "town string, name string, lat double, lon double, lat2 double, lon2 double")).collect()
    assert {(r.town, r.a, r.b): (round(r.lat, 9), round(r.lon, 9)) for r in made} == want and len(want) > 300


def test_the_name_among_a_few(spark):
    names = spark.createDataFrame([("x", "fox street", "fox"), ("x", "summer road", "summer"), ("y", "summer road", "summer")], "street string, name string, core string")
    asked = spark.createDataFrame([("x", "ox"), ("x", "fox"), ("x", "sumner"), ("y", "sumer"), ("y", "sonner"), ("y", "zzzzzz")], "street string, heard string")
    assert {(r.street, r.heard, r.name) for r in streets.best_of(asked, names, ["street"]).collect()} == {("x", "fox", "fox street"), ("x", "sumner", "summer road")} | {("y", "sumer", "summer road")}


PLACES = [
    ("elm hall", "hall", "hall", "ayr"), ("elm", "elm stop", "rail", "ayr"), ("ayr", "ayr", "town", "ayr"), ("ayr", "ayr stop", "rail", "ayr"), ("bury", "bury", "town", "bury"), ("oak street", "oak stop", "rail", "ayr"), ("9", "route nine", "road", "ayr"),
    ("old elm hall yard", "yard", "hall", "bury"), ("dome", "dome", "hall", "ayr"), ("hall yard", "back yard", "hall", "ayr"),
]


@pytest.mark.parametrize("most", [gazetteer.MOST_NAMES, 1])
def test_places_that_texts_name(spark, most):
    """Longest first, guards, scope; by automaton and by join."""
    cases = [
        ("at Elm Hall now", ["ayr"], "hall"), ("fire at the dome street side", None, None), ("at 12 dome", None, None), ("at 12, near dome", None, "dome"), ("down in ayr", ["ayr"], "ayr"), ("down in bury", ["ayr"], None), ("down in bury", None, "bury"),
        ("train held in ayr", ["ayr"], "ayr stop"), ("oak street line", ["ayr"], "oak stop"), ("oak street fire", ["ayr"], None), ("9 units", None, None), ("route 9 closed", None, "route nine"), ("old elm hall yard", ["ayr"], "back yard"), ("old elm hall yard", None, "yard"),
        ("dome and elm hall", ["ayr"], "hall"), (None, None, None), ("", ["ayr"], None), ("elm hall hall yard", None, "back yard"),
    ]
    texts = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "id int, text string, towns array<string>").repartition(3)
    places = spark.createDataFrame([(*p, 0.0, 0.0) for p in PLACES], "alias string, place string, kind string, town string, lat double, lon double")
    got = {r.id: r.place for r in gazetteer.scan(texts, places, most_names=most).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}
