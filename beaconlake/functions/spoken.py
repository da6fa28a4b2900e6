"""Letters and digits spelled on the air, read back as what they spell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.functions import text as tx

# The international spelling alphabet, the older police one, and spoken digits.
SPELLING = "alfa alpha bravo charlie delta echo foxtrot golf hotel india juliet juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu"
POLICE = "adam boy charles david edward frank george henry ida john king lincoln mary nora ocean paul queen robert sam tom union victor william young zebra"
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "niner": "9"}


def _table() -> dict[str, str]:
    return {w: w[0].upper() for w in f"{SPELLING} {POLICE}".split()} | DIGITS


def spelled_runs(text: Column, least: int = 3) -> Column:
    """array<struct<text, used, phonetic, spoken>> of the runs of ``least`` or more spelling words, digits,
    single letters and short numbers; phonetic and spoken say how many words were meant as spelling."""
    known = F.create_map(*[F.lit(x) for pair in _table().items() for x in pair])
    words = tx.tokens(F.regexp_replace(text, r"(?i)\bx[\s.-]+ray\b", "xray"))

    def read(w: Column) -> Column:
        said = F.element_at(known, w)
        plain = F.when(w.rlike("^([a-z]|[0-9]{1,4})$"), F.upper(w))
        return F.struct(F.coalesce(said, plain).alias("c"), (said.isNotNull() & ~w.isin(*DIGITS)).cast("int").alias("p"), said.isNotNull().cast("int").alias("s"))

    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("phonetic"), F.lit(0).alias("spoken"))
    zero = F.struct(none.alias("run"), F.array().cast("array<struct<text:string,used:int,phonetic:int,spoken:int>>").alias("done"))
    closed = lambda a: F.when(a["run"]["used"] >= least, F.concat(a["done"], F.array(a["run"]))).otherwise(a["done"])

    def fold(a: Column, w: Column) -> Column:
        run = a["run"]
        longer = F.struct(F.concat(run["text"], w["c"]).alias("text"), (run["used"] + 1).alias("used"), (run["phonetic"] + w["p"]).alias("phonetic"), (run["spoken"] + w["s"]).alias("spoken"))
        return F.when(w["c"].isNotNull(), F.struct(longer.alias("run"), a["done"].alias("done"))).otherwise(F.struct(none.alias("run"), closed(a).alias("done")))

    return F.aggregate(F.transform(words, read), zero, fold, closed)


def plate_keys(text: Column) -> Column:
    """Hashes of spelled runs of five to eight characters, letters and digits both, most of them spelled; the plates themselves are not passed on."""
    fits = lambda r: F.length(r["text"]).between(5, 8) & r["text"].rlike("[A-Z]") & r["text"].rlike("[0-9]") & (r["spoken"] * 2 >= r["used"])
    return F.transform(F.filter(spelled_runs(text), fits), lambda r: F.substring(F.sha2(r["text"], 256), 1, 16))
