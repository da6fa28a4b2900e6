"""Nothing personal is left in a masked text, whatever overlaps."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from beaconlake.functions import personal
from beaconlake.plans import personal as plans


def key(value, salt=""):
    return hashlib.sha256((salt + "".join(c for c in value if c.isalnum() and c.isascii()).upper()).encode()).hexdigest()[:16]


def test_overlaps_go_to_the_first_in_priority(spark):
    cases = [
        ("dob 4/5/1980 and license S1234567", "[birth] and [licence]", {"birth": ["dob 4/5/1980"], "licence": ["license S1234567"]}),
        ("license number 123456789012", "[licence]012", {"licence": ["license number 123456789"]}),  # digits of a licence are no card
        ("card 4111 1111 4111111111111111", "card 4111 1111 [card]", {"card": ["4111111111111111"]}),
        ("+1 (617) 555-1234, 617.555.1234", "[phone], [phone]", {"phone": ["+1 (617) 555-1234", "617.555.1234"]}),
        ("a.b@mail3.example.com at 10.0.0.1", "[address] at [host]", {"address": ["a.b@mail3.example.com"], "host": ["10.0.0.1"]}),
        ("plate AB1 23X, last name Corvane Hall", "[plate], [name]", {"plate": ["plate AB1 23X"], "name": ["last name Corvane Hall"]}),
        (None, "", {}), ("", "", {}), ("nothing here", "nothing here", {}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    rest, keys = personal.masked(F.col("t"), "s")
    got = {r.i: r for r in df.select("i", rest.alias("rest"), *(k.alias(n) for n, k in keys.items())).collect()}
    for i, (_, want, found) in enumerate(cases):
        assert got[i].rest == want
        assert {n: list(got[i][n]) for n in keys} == {n: [key(v, "s") for v in found.get(n, [])] for n in keys}
        assert not any(v in "|".join(map(str, got[i])) for vs in found.values() for v in vs)


def test_spelled_runs_are_masked(spark):
    cases = [
        ("plate is adam boy three four x ray niner thank you", "plate is [spelled] thank you", ["AB34X9"]), ("it is adam 7, victor nine 12 out", "it is [spelled] out", ["A7V912"]), ("adam boy three", "adam boy three", []),
        ("madam boy three four five six", "madam [spelled]", ["B3456"]), (None, "", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    rest, keys = personal.masked_spelled(F.col("t"))
    got = {r.i: (r.rest, list(r["keys"])) for r in df.select("i", rest.alias("rest"), keys.alias("keys")).collect()}
    assert got == {i: (want, [key(v) for v in values]) for i, (_, want, values) in enumerate(cases)}


def test_each_pattern_is_asked_once(spark, tmp_path):
    """The text that an extractor leaves is worked out once and not anew by every later one: a pattern is in the plan for its keys and its tag only."""
    spark.createDataFrame([(1, "dob 4/5/1980, license S1234567, last name Corvane"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = plans.personal_masked(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in personal.EXTRACTORS.values()] == [2] * len(personal.EXTRACTORS)
    assert {r.doc_id: (r.n_birth, r.n_licence, r.n_card, r.n_name) for r in made.collect()} == {1: (1, 1, 0, 1), 2: (0, 0, 0, 0)}
