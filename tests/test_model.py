"""Budgets, breakers, answers and verdicts with scripted providers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from beaconlake.operators import model

T0 = datetime(2024, 3, 5, 17, 0)
LINE = "message string, at timestamp, src string, text string, feed_town string, rule_noise boolean, rule_units array<string>, rule_call_type string, rule_clear boolean, rule_stop boolean, rule_record boolean, rule_fact boolean"


def lines(spark, rows):
    base = {"src": "f", "feed_town": None, "rule_noise": None, "rule_units": ["R1"], "rule_call_type": "rule", "rule_clear": False, "rule_stop": False, "rule_record": False, "rule_fact": False}
    return spark.createDataFrame([tuple((base | r)[c.split(" ")[0]] for c in LINE.split(", ")) for r in rows], LINE).repartition(4)


def line(i, text="a long line", **more):
    return {"message": f"m{i:03}", "at": T0 + timedelta(seconds=i), "text": text} | more


def provider(answers=None, fails=lambda text: False, log=None):
    class Scripted:
        def ask(self, task, payload):
            if log:
                with open(log, "a") as f:
                    f.write(payload.get("text", payload.get("claim", "")) + "\n")
            if fails(payload.get("text", payload.get("claim", ""))):
                raise TimeoutError("no answer")
            return answers(payload) if answers else {"units": [payload["text"].split(" ")[0]], "call_type": "model"}

    return Scripted()


def test_offline_is_the_default(spark):
    got = model.extract(lines(spark, [line(0), line(1, rule_noise=True), line(2, rule_clear=True, rule_stop=True, feed_town="Ayr")])).orderBy("message").collect()
    assert [(r.by, r.why, r.call_type, r.clear, r.stop, r.noise, r.town) for r in got] == [("rules", "offline", "rule", False, False, False, None), ("noise", "noise", "rule", False, False, True, None), ("rules", "offline", "rule", True, True, False, "Ayr")]


def test_budget_of_a_day_holds_over_tasks_and_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [line(i, f"line {i}") for i in range(150)] + [line(500, "noise", rule_noise=True), line(90_000, "tomorrow")]
    got = model.extract(lines(spark, rows), provider(log=log), cap=100).collect()
    by = {r.message: r.by for r in got}
    assert len(got) == 152 and [m for m, b in sorted(by.items()) if b == "model"] == [f"m{i:03}" for i in range(50, 150)] + ["m90000"]
    assert {r.why for r in got if r.by == "rules"} == {"budget"}
    assert len(open(log).read().split("\n")) == 102  # the rows were counted too, and nothing asked again
    ledger = model.spending(model.extract(lines(spark, rows), provider(), cap=100))
    assert sorted((r.day, r.used) for r in ledger.collect()) == [("2024-03-05", 100), ("2024-03-06", 1)]
    later = model.extract(lines(spark, [line(i) for i in range(60)]), provider(), cap=130, spent=ledger).collect()
    assert sorted(r.message for r in later if r.by == "model") == [f"m{i:03}" for i in range(30, 60)]
    assert all(r.by == "rules" for r in model.extract(lines(spark, [line(0)]), provider(), cap=100, spent=ledger).collect())


def test_breaker_holds_across_tasks(spark, tmp_path):
    """After the first failure nobody asks; the lines go through by rules."""
    log = str(tmp_path / "log")
    rows = lines(spark, [line(i, f"l{i}") for i in range(200)]).coalesce(1).repartition(40, "message")
    got = model.extract(rows, provider(fails=lambda t: True, log=log)).collect()
    assert {r.by for r in got} == {"rules"} and len(got) == 200
    asked = len(open(log).read().split())
    assert 1 <= asked <= 8 and sum(r.why == "failed: TimeoutError" for r in got) == asked and {r.why for r in got} == {"failed: TimeoutError", "down"}


def test_fields(spark):
    told = {
        "a": {"units": ["Engine 5", "car-12", ""], "call_type": " fire ", "landmark": "Fenwick Park", "town": "Ayr", "is_clear": True, "noise": True}, "b": {"landmark": "Quantum Gardens", "town": "n/a", "call_type": "null", "is_clear": True, "noise": True},
        "c": {"landmark": "North Bridge", "is_stop": True}, "d": {"units": "no list"}, "e": [1],
    }
    answers = lambda payload: told[payload["text"][0]]
    rows = [line(0, "a over at fenwick", rule_record=True), line(1, "b nothing of it", rule_fact=True, feed_town="Bury"), line(2, "c the northern line"), line(3, "d odd"), line(4, "e odder")]
    got = {r.text[0]: r for r in model.extract(lines(spark, rows), provider(answers)).collect()}
    assert (got["a"].units, got["a"].call_type, got["a"].landmark, got["a"].town, got["a"].clear, got["a"].noise, got["a"].invented) == (["ENGINE5", "CAR12"], "fire", "Fenwick Park", "Ayr", False, True, False)
    assert (got["b"].landmark, got["b"].town, got["b"].call_type, got["b"].clear, got["b"].noise, got["b"].invented) == (None, "Bury", None, True, False, True)
    assert (got["c"].landmark, got["c"].stop, got["c"].invented) == (None, True, True)
    assert got["d"].by == "model" and got["d"].units == [] and got["e"].by in ("model", "rules")


def test_context_is_of_the_channel(spark):
    rows = [line(i, f"text {i}", src="f" if i % 2 else "g") for i in range(9)]
    got = {r.message: r.call_type for r in model.extract(lines(spark, rows), provider(lambda p: {"call_type": "|".join(p["before"])})).collect()}
    assert got["m008"] == "text 2|text 4|text 6" and got["m003"] == "text 1" and got["m001"] is None


SITUATION = "run int, id string, headline string, summary string, type string, priority string, confidence string, updates string, related string, feeds array<string>"


def situations(spark, rows):
    return spark.createDataFrame(rows, SITUATION)


def test_disposition_and_verdicts(spark):
    heard = spark.createDataFrame([(1, "F1", T0, "shots fired by the station"), (1, "f2", T0 + timedelta(seconds=1), "quiet"), (2, "f3", T0, "we can confirm a fire")], "run int, feed string, at timestamp, text string")
    s = situations(spark, [
        (1, "a", "Shots fired - Confirmed", "s", "Crime", "HIGH", "confirmed", "x", "gone", ["f1", "f9"]), (1, "b", "Active shooter", "s", None, "high", "reported", None, "x", None),
        (2, "c", "Fire confirmed", "s", "fire", "high", "CONFIRMED", None, None, ["F3"]), (3, "d", "Nobody spoke", None, "x", "high", "sure", None, None, []),
    ])
    board = spark.createDataFrame([("x",), ("x",)], "id string")
    cut = model.disposed(s, heard, board, [("active shooter", "shooter|shots at"), ("shots fired", "shots fired")])
    got = {r.id: r for r in cut.collect()}
    assert (got["a"].headline, got["a"].confidence, got["a"].priority, got["a"].updates, got["a"].related, got["a"].feeds, got["a"].trimmed, got["a"].held) == ("Shots fired", "reported", "normal", "x", None, ["f1"], True, False)
    assert (got["b"].held, got["b"].held_why, got["b"].priority, got["b"].confidence, got["b"].related) == (True, "no line supports: active shooter", "normal", "unclear", "x")
    assert (got["c"].headline, got["c"].confidence, got["c"].trimmed, got["c"].priority) == ("Fire confirmed", "confirmed", False, "high") and got["d"].confidence == "reported"
    assert model.publishable(model.verified(cut, heard)).count() == 0
    assert {r.held_why for r in model.verified(cut, heard).collect()} == {"unverified: offline", "no line supports: active shooter", "no lines behind this claim"}
    yes = provider(lambda p: {"supported": True, "quote": p["lines"]})
    fine = {r.id: r for r in model.verified(cut, heard, [provider(fails=lambda t: True), yes]).collect()}  # the second skeptic answers
    assert {i: (r.verified, r.held) for i, r in fine.items()} == {"a": (True, False), "b": (True, True), "c": (True, False), "d": (False, True)}
    assert fine["a"].quote == "shots fired by the station\nquiet" and fine["c"].confidence == "confirmed" and fine["d"].confidence == "unclear"
    no = model.verified(cut, heard, [provider(lambda p: {"supported": "c" == p["claim"][0], "refutes": "nobody said so"})])
    assert {r.held_why for r in no.filter("id IN ('a', 'c')").collect()} == {"not stood up: nobody said so"} and model.publishable(no).count() == 0
    assert model.publishable(model.verified(cut, heard, [yes]).withColumn("x", F.lit(1))).count() == 2
