"""Personal data in texts: masked, and known only by hashes.

Extractors come in order of priority.  Each replaces what it finds by its tag before the next one looks,
so of spans that overlap the first in priority is masked whole and the others are not found in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.functions import spoken

_WORD = rf"(?:x[ .-]+ray|{'|'.join(sorted(spoken._table(), key=len, reverse=True))})(?![A-Za-z0-9])"
_SIGN = rf"(?:{_WORD}|(?:[A-Za-z]|[0-9]{{1,4}})(?![A-Za-z0-9]))"
#: Runs of five or more spelled letters and digits, of which the first and the third are words.
SPELLED = rf"(?i)(?<![A-Za-z0-9]){_WORD}[ ,.]+{_SIGN}[ ,.]+{_WORD}(?:[ ,.]+{_SIGN}){{2,}}"
# Patterns of our own, which both engines read alike.
EXTRACTORS: dict[str, str] = {
    "birth": r"(?:dob|born|date of birth):? ?[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}",
    "licence": r"licen[cs]e (?:number )?[A-Z]?[0-9]{7,9}",
    "card": "[0-9]{13,16}",
    "phone": r"(?:\+?[0-9]{1,2} )?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
    "address": r"[a-z0-9.]+@[a-z0-9]+(?:\.[a-z0-9]+)+",
    "host": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "plate": r"(?:plate|registration) [A-Z0-9]{2,4}[- ]?[A-Z0-9]{2,4}",
    "name": r"(?:last name|name of|operator is) [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}


def key(value: Column, salt: str = "") -> Column:
    """What a value is linked by: a hash of its letters and digits, in capitals."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))), 256), 1, 16)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def found(text: Column, salt: str = "", extractors: dict[str, str] = EXTRACTORS) -> Column:
    """struct<rest, one array of keys for each kind>: the text with ``[kind]`` in place of what was found, and the keys in order; a null text is empty.

    Each text goes through each pattern once for the keys and, if there are any, once more for the tag.
    """

    def step(kind: str, pattern: str, before: list[str]) -> Callable[[Column], Column]:
        rest = lambda s: F.when(F.size(s["hits"]) > 0, F.regexp_replace(s["rest"], pattern, f"[{kind}]")).otherwise(s["rest"])
        done = lambda s: F.struct(rest(s).alias("rest"), *(s["s"][k].alias(k) for k in before), F.transform(s["hits"], lambda v: key(v, salt)).alias(kind))
        return lambda s: _once(F.struct(s.alias("s"), s["rest"].alias("rest"), F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(0)).alias("hits")), done)

    state, kinds = F.struct(F.coalesce(text, F.lit("")).alias("rest")), list(extractors)
    for i, kind in enumerate(kinds):
        state = _once(state, step(kind, extractors[kind], kinds[:i]))
    return state


def masked(text: Column, salt: str = "", extractors: dict[str, str] = EXTRACTORS) -> tuple[Column, dict[str, Column]]:
    """:func:`found` as columns: the text and the keys of each kind."""
    state = found(text, salt, extractors)
    return state["rest"], {kind: state[kind] for kind in extractors}


def masked_spelled(text: Column, salt: str = "") -> tuple[Column, Column]:
    """The text with ``[spelled]`` in place of spelled runs, and the keys of what they spell."""
    whole = F.coalesce(text, F.lit(""))
    runs = F.flatten(F.transform(F.regexp_extract_all(whole, F.lit(SPELLED), F.lit(0)), lambda r: F.transform(spoken.spelled_runs(r), lambda s: key(s["text"], salt))))
    return F.regexp_replace(whole, SPELLED, "[spelled]"), runs
