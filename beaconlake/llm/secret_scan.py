"""Secret scans with DataFrame functions only: fixed patterns, and two character Markov models.

The patterns find secrets that announce themselves.  What else is a secret is told by two models of
the order of characters, one of random strings and one of ordinary identifiers: a run of
characters is reported if its log-likelihood ratio passes a margin.  The models are counts of
character pairs over labelled samples: values that the patterns find, and words of the texts.

Places of matches come from the pieces between them: a running sum over an array, in log(n) rounds,
so a row with many matches costs no more than it holds, and nothing is shuffled but the samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.scratch import Scratch

# The patterns of the contract; group 1 of the first is the value, and the look ahead only saves time.
ASSIGN = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run; any other, and the begin of a run, is state 0 of the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(ALPHABET) + 1
_CLASS = "[A-Za-z0-9+/_-]"
RUN = f"(?<!{_CLASS}){_CLASS}{{16,}}"
WORD = f"(?<!{_CLASS}){_CLASS}{{4,}}"
#: Documents, about, whose words are samples of identifiers; values of secrets are taken from all.
SAMPLE_DOCS = 20_000
#: What any pair of characters keeps of even odds, and the log-likelihood ratio from which a run is a secret.
EVEN_RANDOM, EVEN_WORD = 0.3, 0.05
MARGIN = 14.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array: round k adds the element 2^k places before."""

    def step(held: Column, k: Column) -> Column:
        return F.transform(held, lambda x, i: x + F.coalesce(F.get(held, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))

    return _let(numbers, lambda s: F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + F.lit(1))).cast("int")), s, step))


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.char_length(t))


def _gaps(text: Column, pattern: str) -> Column:
    """Code points before, between and behind the matches: one number if there is none."""
    return _lengths(F.split(text, pattern, -1))


def _hits(text: Column, pattern: str, gaps: Column, group: int = 0) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(gaps) > 1, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def _starts(hits: Column, gaps: Column) -> Column:
    return running_sums(F.zip_with(F.concat(F.array(F.lit(0)), _lengths(hits)), gaps, lambda h, g: h + g))


def _spans(hits: Column, gaps: Column, values: Column | None = None) -> Column:
    """Structs (start, end, value) of the matches, in order."""
    placed = F.zip_with(hits, _starts(hits, gaps), lambda h, s: F.when(h.isNotNull(), F.struct(s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("value"))))
    if values is not None:
        placed = F.zip_with(placed, values, lambda p, v: F.when(v.isNotNull(), F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value"))))
    return F.filter(placed, lambda p: p.isNotNull())


def _unclear(value: Column) -> Column:
    """Whether a run holds a letter and no span of the patterns."""
    return value.rlike("[A-Za-z]") & ~value.rlike(f"{ACCESS}|{HEX}")


def find(docs: DataFrame, sample: float, *, key: str, text: str) -> DataFrame:
    """A row per document: key, spans of the three patterns, runs (spans that a model must judge), words (samples, of the part ``sample`` of all documents)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    drawn = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(17)), F.lit(1 << 20)) < round(sample * (1 << 20))
    cut = docs.select(F.col(key).alias("key"), whole.alias("text"), drawn.alias("drawn"))
    cut = cut.select("*", _gaps(F.col("text"), ASSIGN).alias("g1"), _gaps(F.col("text"), ACCESS).alias("g2"), _gaps(F.col("text"), HEX).alias("g3"))
    hit = cut.select("*", *(_hits(F.col("text"), p, F.col(g), n).alias(h) for h, p, g, n in (("h1", ASSIGN, "g1", 0), ("v1", ASSIGN, "g1", 1), ("h2", ACCESS, "g2", 0), ("h3", HEX, "g3", 0))))
    # What the first pattern matched is blank for the runs, character by character.
    blank = F.zip_with(F.split("text", ASSIGN, -1), _lengths(F.col("h1")), lambda p, n: F.concat(p, F.call_function("repeat", F.lit(" "), F.coalesce(n, F.lit(0)))))
    rest = F.when(F.size("g1") > 1, F.array_join(blank, "")).otherwise(F.col("text"))
    base = hit.select(
        "key",
        "drawn",
        F.filter(_spans(F.col("h1"), F.col("g1"), F.col("v1")), lambda s: F.char_length(s["value"]) >= LEAST_VALUE).alias("assign"),
        _spans(F.col("h2"), F.col("g2")).alias("access"),
        _spans(F.col("h3"), F.col("g3")).alias("hex"),
        rest.alias("rest"),
    )
    runs = base.select("*", _gaps(F.col("rest"), RUN).alias("g4"))
    runs = runs.select("*", _hits(F.col("rest"), RUN, F.col("g4")).alias("h4"))
    words = F.filter(F.array_distinct(F.regexp_extract_all("rest", F.lit(WORD), F.lit(0))), _unclear)
    return runs.select(
        "key",
        "assign",
        "access",
        "hex",
        F.filter(_spans(F.col("h4"), F.col("g4")), lambda s: _unclear(s["value"])).alias("runs"),
        F.when(F.col("drawn"), words).alias("words"),
    )


def _array(values: list, kind: str) -> Column:
    return F.expr(f"array({', '.join(f'{v!r}{kind}' for v in values)})")


def _states(value: Column) -> Column:
    """The states of the models that a string goes through."""
    table = _array([ALPHABET.find(chr(c)) + 1 for c in range(128)], "")
    return F.transform(F.split(value, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))


def _pairs(value: Column) -> Column:
    """Each pair of states in a row, from the begin on, as one number."""
    return _let(_states(value), lambda s: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(s, 1, F.size(s) - 1)), s, lambda a, b: a * STATES + b))


def train(samples: DataFrame, even_random: float = EVEN_RANDOM, even_word: float = EVEN_WORD) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of every pair of states, from samples (value string, random boolean).

    Each different value counts once; null and empty ones don't.  A model without samples is even.
    The driver gets two counts for each pair of states at most.
    """
    once = samples.filter("value <> ''").groupBy("random", "value").agg(F.lit(1).alias("_one"))
    counted = once.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("random", "pair").count().collect()
    tables = []
    for random, even in ((True, even_random), (False, even_word)):
        seen = [0] * (STATES * STATES)
        for r in counted:
            if r.random == random:
                seen[r.pair] = r["count"]
        own: list[float] = []
        for a in range(STATES):
            row = seen[a * STATES : (a + 1) * STATES]
            total = sum(row)
            own += [(1 - even) * n / total + even / STATES if total else 1 / STATES for n in row]
        tables.append(own)
    return [math.log(p / q) for p, q in zip(*tables)]


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string: how much likelier it is as a random string than as an identifier."""
    held = _array(table, "D")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + F.get(held, pair))


def samples_of(found: DataFrame) -> DataFrame:
    """Labelled samples (value, random): values of the patterns, those given to a name only with a digit; words of the texts drawn."""
    digit = F.filter("assign", lambda s: s["value"].rlike("[0-9]"))
    values = F.concat(F.transform(digit, lambda s: s["value"]), F.transform("access", lambda s: F.substring(s["value"], 5, 1 << 30)), F.transform("hex", lambda s: s["value"]))
    secret = found.filter(F.size("assign") + F.size("access") + F.size("hex") > 0).select(F.explode(values).alias("value"), F.lit(True).alias("random"))
    plain = found.filter("words is not null").select(F.explode("words").alias("value"), F.lit(False).alias("random"))
    return secret.union(plain)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", samples: DataFrame | None = None, margin: float = MARGIN, sample_docs: int = SAMPLE_DOCS, label: str = "secrets") -> DataFrame:
    """A row per document: key and the spans assign, access, hex, random, each an array of (start, end, value), by code points.

    ``random`` are runs of 16 characters or more outside the other spans that hold a letter and whose
    ratio is at least ``margin``, by models of ``samples`` (value, random); without those, of
    what the patterns found in all documents and of the words of about ``sample_docs`` documents,
    drawn by a hash.  A run that a match of the first pattern cuts is judged without it.

    Null and empty texts have no spans.  Rows that repeat a key each give a row, null keys are kept, an
    empty table gives none.  Texts are read once; what was found is written between the steps.
    """
    scratch = Scratch(docs.sparkSession, label)
    part = 0.0 if samples is not None else min(1.0, sample_docs / max(1, docs.count()))
    found = scratch.table(find(docs, part, key=key, text=text), "found")
    table = train(samples_of(found) if samples is None else samples)
    return found.select(F.col("key").alias(key), "assign", "access", "hex", F.filter("runs", lambda s: ratio(s["value"], table) >= margin).alias("random"))


def secret_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per span: key, kind, start, end, value (of an assignment the value alone); rows as :func:`scan` states."""
    found = scan(docs, key=key, text=text, **options)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in KINDS))
    by_kind = found.select(key, F.inline(kinds))
    return by_kind.select(key, "kind", F.inline("spans"))


def _written(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the first kinds by start, then kind, joined by commas."""

    def keyed(i: int) -> Column:
        return F.transform(KINDS[i], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(keyed, range(len(kinds))))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op13_secrets(docs: DataFrame) -> DataFrame:
    """Contract columns of :func:`scan`, which states nulls, repeats and empty tables."""
    return scan(docs).select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(_written(KINDS[:3]), 256).alias("base_sha256"),
        _written(KINDS).alias("spans"),
    )
