"""Work that a language model may do, and what becomes of its answers.

A provider is any object with ``ask(task, payload)``; none is the default, and then rules do what they
can and claims stay held.  What may be asked is decided in the plan: a budget by local day, the
freshest lines first.  A provider that fails once in a run is asked no more by any task of it: the first
failure leaves a file in the shared folder that every task looks for before it asks.  Answers are
written before they are used, so nothing is asked again because a plan runs twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import text as tx
from beaconlake.functions.localtime import day_key
from beaconlake.sources.shared import fresh_folder

DAILY = 4000
CONTEXT_LINES, CONTEXT_CHARS = 3, 220
#: What a model writes where it knows nothing.
NOTHING = ("null", "none", "n/a", "na", "unknown", "unclear", "undefined", "")
#: Words of names that many names have; one of them alone is not a name heard.
GENERIC = ("street", "road", "avenue", "square", "lane", "hall", "park", "bridge", "north", "south", "east", "west")
ANSWER = "units array<string>, call_type string, landmark string, town string, is_clear boolean, is_stop boolean, noise boolean"
VERDICT = "supported boolean, quote string, refutes string"


class Provider(Protocol):
    def ask(self, task: str, payload: dict) -> dict:
        """The answer to one request; raises if there is none."""


class _Breaker:
    """A file that says that the provider is down."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.open = False

    def tripped(self) -> bool:
        from pyarrow import fs

        self.open = self.open or self.files.get_file_info(f"{self.root}/down").type != fs.FileType.NotFound
        return self.open

    def trip(self) -> None:
        self.files.create_dir(self.root, recursive=True)
        with self.files.open_output_stream(f"{self.root}/down") as f:
            f.write(b"")
        self.open = True


def asked(rows: DataFrame, providers: list[Provider], task: str, payload: Column, allowed: Column, label: str = "model", unkept: tuple[str, ...] = ()) -> DataFrame:
    """``rows``, without the columns ``unkept``, with answer (JSON) and why (null if answered): 'not asked', 'offline', 'down' or 'failed: ' with the error.

    Where one provider fails the next is tried for the same row; each has its own breaker.  A task that is run again asks again.
    """
    folder = fresh_folder(rows.sparkSession, label)
    kept = [c for c in rows.columns if c not in unkept]
    ready = rows.select(*kept, F.when(allowed, payload).alias("_payload"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breakers = [_Breaker(f"{folder}/breaker{i}") for i in range(len(providers))]
        for pdf in pdfs:
            found = [one(breakers, p) for p in pdf["_payload"]]
            yield pdf[kept].assign(answer=[a for a, _ in found], why=[w for _, w in found])

    def one(breakers: list[_Breaker], request: str | None) -> tuple[str | None, str | None]:
        if request is None or pd.isna(request):
            return None, "not asked"
        why = "offline" if not providers else "down"
        for provider, breaker in zip(providers, breakers):
            if breaker.tripped():
                continue
            try:
                return json.dumps(provider.ask(task, json.loads(request))), None
            except Exception as error:  # whatever a provider does, the row has to come through
                breaker.trip()
                why = f"failed: {type(error).__name__}"
        return None, why

    if providers:
        made = ready.mapInPandas(run, rows.select(*kept).schema.add("answer", "string").add("why", "string"))
    else:
        made = ready.select(*kept, F.lit(None).cast("string").alias("answer"), F.when(F.col("_payload").isNull(), "not asked").otherwise("offline").alias("why"))
    made.write.parquet(f"{folder}/answers")
    return rows.sparkSession.read.schema(made.schema).parquet(f"{folder}/answers")


def within_budget(rows: DataFrame, wants: Column, cap: int, spent: DataFrame | None = None, at: str = "at", tie: str = "message") -> DataFrame:
    """``rows`` with allowed: of those that ``wants``, the freshest ``cap`` of every local day, less what is ``spent`` (day, used).

    A day is counted by minutes, of which one at most is ranked row by row.
    """
    marked = rows.withColumns({"_wants": F.coalesce(wants, F.lit(False)), "_day": day_key(F.col(at)), "_minute": F.date_trunc("minute", at)})
    minutes = marked.filter("_wants").groupBy(F.col("_day").alias("_d"), F.col("_minute").alias("_m")).agg(F.count("*").alias("_n"))
    fresher = F.coalesce(F.sum("_n").over(Window.partitionBy("_d").orderBy(F.desc("_m")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = F.lit(0)
    if spent is not None:
        minutes, used = minutes.join(spent.groupBy(F.col("day").alias("_sd")).agg(F.sum("used").alias("_used")), F.col("_d") == F.col("_sd"), "left"), F.coalesce("_used", F.lit(0))
    room = minutes.select("_d", "_m", "_n", (F.lit(cap) - used - fresher).alias("_room"))
    known = marked.join(room, (F.col("_day") == F.col("_d")) & (F.col("_minute") == F.col("_m")), "left")
    whole = known.filter(~F.col("_wants") | F.col("_room").isNull() | (F.col("_room") <= 0) | (F.col("_room") >= F.col("_n"))).withColumn("allowed", F.coalesce(F.col("_wants") & (F.col("_room") >= F.col("_n")), F.lit(False)))
    cut = known.filter(F.col("_wants") & (F.col("_room") > 0) & (F.col("_room") < F.col("_n")))
    cut = cut.withColumn("allowed", F.row_number().over(Window.partitionBy("_day", "_minute").orderBy(F.desc(at), tie)) <= F.col("_room"))
    return whole.unionByName(cut).select(*rows.columns, "allowed")


def _known(value: Column) -> Column:
    """What a model wrote, trimmed; null where that says nothing."""
    said = F.trim(value)
    return F.when(~F.lower(said).isin(*NOTHING), said)


def heard(name: Column, said: Column) -> Column:
    """Whether a name was said: all of it, or a word of it of four letters or more that not many names have."""
    flat, line = tx.plain(name), F.concat(F.lit(" "), tx.plain(said), F.lit(" "))
    telling = F.filter(F.split(flat, " "), lambda w: (F.length(w) > 3) & ~w.isin(*GENERIC))
    return (flat != "") & (F.contains(line, flat) | F.exists(telling, lambda w: F.contains(line, w)))


def extract(lines: DataFrame, provider: Provider | None = None, cap: int = DAILY, spent: DataFrame | None = None) -> DataFrame:
    """Lines with units, call_type, landmark, town, clear, stop, noise, invented, by ('model', 'rules' or 'noise') and why.

    ``lines``: message, at, src, text, feed_town, and what rules made of them: rule_noise, rule_units, rule_call_type,
    rule_clear, rule_stop, rule_record (an answer of the records desk), rule_fact (something in the line speaks
    for itself).  A line of noise is not asked.  A model sees the line and the three before it on its channel.
    Of its answer a landmark counts if it was heard, a town if the channel has none, 'clear' if the line
    is no records answer, 'noise' if no fact speaks against it; a stop counts whoever saw it.
    """
    before = F.collect_list(F.substring("text", 1, CONTEXT_CHARS)).over(Window.partitionBy("src", day_key(F.col("at"))).orderBy("at", "message").rowsBetween(-CONTEXT_LINES, -1))
    ready = within_budget(lines.withColumn("_before", before), ~F.coalesce("rule_noise", F.lit(False)) & F.lit(provider is not None), cap, spent)
    told = asked(ready, [provider] if provider else [], "extract", F.to_json(F.struct("text", F.col("_before").alias("before"), "src", "feed_town")), F.col("allowed"))
    a = F.from_json("answer", ANSWER)
    told = told.withColumn("_a", F.when(F.col("answer").isNotNull(), a)).withColumn("_mark", _known(F.col("_a.landmark")))
    by_model = F.col("_a").isNotNull()
    rule = lambda c: F.coalesce(F.col(f"rule_{c}"), F.lit(False))
    flag = lambda c: F.coalesce(F.col(f"_a.{c}"), F.lit(False))
    units = F.filter(F.transform("_a.units", lambda u: F.regexp_replace(F.upper(u), r"[\s-]", "")), lambda u: u != "")
    real = heard(F.col("_mark"), F.col("text"))
    why = F.when(by_model, None).when(rule("noise"), "noise").when(F.lit(provider is None), "offline").when(~F.col("allowed"), "budget").when(F.col("answer").isNotNull(), "no answer that can be read").otherwise(F.col("why"))
    return told.select(
        *lines.columns,
        F.when(by_model, F.coalesce(units, F.array().cast("array<string>"))).otherwise(F.col("rule_units")).alias("units"),
        F.when(by_model, _known(F.col("_a.call_type"))).otherwise(F.col("rule_call_type")).alias("call_type"),
        F.when(real, F.col("_mark")).alias("landmark"),
        F.coalesce("feed_town", _known(F.col("_a.town"))).alias("town"),
        F.when(by_model, flag("is_clear") & ~rule("record")).otherwise(rule("clear")).alias("clear"),
        (flag("is_stop") | rule("stop")).alias("stop"),
        F.when(by_model, flag("noise") & ~rule("fact")).otherwise(rule("noise")).alias("noise"),
        F.coalesce(F.col("_mark").isNotNull() & ~real, F.lit(False)).alias("invented"),
        F.when(by_model, "model").when(rule("noise"), "noise").otherwise("rules").alias("by"),
        why.alias("why"),
    )


def spending(extracted: DataFrame) -> DataFrame:
    """What a run adds to the day's ledger: (day, used), answers and failures alike."""
    tried = F.col("why").isNull() | F.col("why").startswith("failed") | (F.col("why") == "no answer that can be read")
    return extracted.filter(tried).groupBy(day_key(F.col("at")).alias("day")).agg(F.count("*").alias("used"))


def disposed(situations: DataFrame, lines: DataFrame, board: DataFrame, claims: list[tuple[str, str]], confirms: str = r"\bconfirm(?:s|ed)?\b") -> DataFrame:
    """What a model wrote about runs of lines, cut down to what the lines bear out.

    ``situations``: run, id, headline, summary, type, priority, confidence, updates, related, feeds;
    ``lines``: run, feed, text; ``board``: id.  Values outside their lists take the cautious one, references to unknown
    stories and feeds that were not heard go.  'Confirmed' that nobody said is trimmed.  ``claims`` are pairs of
    patterns, what is claimed and what must have been said: a claim without that is held, and says why.
    """
    said = [F.coalesce(F.max(F.lower("text").rlike(p)), F.lit(False)).alias(f"_s{i}") for i, p in enumerate([confirms, *(e for _, e in claims)])]
    runs = lines.groupBy(F.col("run").alias("_run")).agg(F.collect_set(F.lower("feed")).alias("_feeds"), *said)
    s = situations.join(runs, F.col("run") == F.col("_run"), "left")
    for c in ("updates", "related"):
        s = s.join(board.select(F.col("id").alias(f"_{c}")).distinct(), F.col(c) == F.col(f"_{c}"), "left")
    heard_it = lambda i: F.coalesce(F.col(f"_s{i}"), F.lit(False))
    head, confidence = F.substring(F.coalesce("headline", F.lit("")), 1, 200), F.lower(F.coalesce("confidence", F.lit("")))
    suffix = r"[\s,:-]*\bconfirmed\s*$"
    boast = ~heard_it(0) & (F.lower(head).rlike(suffix) | (confidence == "confirmed"))
    whole = F.lower(F.concat_ws(" ", "headline", "summary"))
    missing = F.array_compact(F.array(*[F.when(whole.rlike(c) & ~heard_it(i + 1), F.regexp_extract(whole, c, 0)) for i, (c, _) in enumerate(claims)])) if claims else F.array().cast("array<string>")
    level = F.when(confidence.isin("confirmed", "reported", "unclear"), confidence).otherwise("reported")
    held = F.size(missing) > 0
    return s.select(
        "run", "id", F.when(heard_it(0), head).otherwise(F.trim(F.regexp_replace(head, f"(?i){suffix}", ""))).alias("headline"), F.substring(F.coalesce("summary", F.lit("")), 1, 600).alias("summary"), F.lower(F.coalesce("type", F.lit("situation"))).alias("type"),
        F.when(held, "normal").when(F.col("priority") == "high", "high").otherwise("normal").alias("priority"), F.when(held, "unclear").when(boast & (level == "confirmed"), "reported").otherwise(level).alias("confidence"),
        F.col("_updates").alias("updates"), F.col("_related").alias("related"), F.filter("feeds", lambda f: F.coalesce(F.array_contains("_feeds", F.lower(f)), F.lit(False))).alias("feeds"),
        boast.alias("trimmed"), held.alias("held"), F.when(held, F.concat(F.lit("no line supports: "), F.array_join(missing, ", "))).alias("held_why"),
    )


def verified(situations: DataFrame, lines: DataFrame, skeptics: list[Provider] | None = None, most_chars: int = 20_000) -> DataFrame:
    """Disposed situations with verified, quote, held and held_why: only what a second model has stood up is not held.

    A skeptic gets the claim and the lines of its run, ``most_chars`` of them, in order.  No answer is no approval.
    """
    # A run's lines are cut before they meet its claims, and go to the skeptic only: answers are written without them.
    text = lines.groupBy(F.col("run").alias("_run")).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n"), 1, most_chars).alias("_lines"))
    ready = situations.join(text, F.col("run") == F.col("_run"), "left").drop("_run")
    payload = F.to_json(F.struct(F.concat_ws(" ", "headline", "summary").alias("claim"), F.col("_lines").alias("lines")))
    told = asked(ready.withColumn("_behind", F.col("_lines").isNotNull()), skeptics or [], "verify", payload, F.col("_behind"), "verify", unkept=("_lines",)).withColumn("_v", F.from_json("answer", VERDICT))
    fine = F.coalesce(F.col("_v.supported"), F.lit(False))
    why = F.when(F.col("held"), F.col("held_why")).when(~F.col("_behind"), "no lines behind this claim").when(F.col("answer").isNotNull(), F.concat(F.lit("not stood up: "), F.coalesce(F.nullif("_v.refutes", F.lit("")), F.lit("no supporting line")))).otherwise(F.concat(F.lit("unverified: "), F.col("why")))
    return told.select(
        *[c for c in situations.columns if c not in ("held", "held_why", "confidence")], F.when(fine & ~F.col("held"), F.col("confidence")).otherwise("unclear").alias("confidence"), fine.alias("verified"), F.when(fine, F.substring("_v.quote", 1, 300)).alias("quote"),
        (~fine | F.col("held")).alias("held"), F.when(~fine | F.col("held"), why).alias("held_why"),
    )


def publishable(situations: DataFrame) -> DataFrame:
    """What may be shown: verified and not held."""
    return situations.filter("verified AND NOT held")
