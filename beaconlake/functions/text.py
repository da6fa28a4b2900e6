"""Text rules as Columns: tokens, lexicon signals with negation and hedging, keys, clocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"


def bounded(pattern: str) -> str:
    """``pattern`` between ASCII word borders (Java's own ``\\b`` looks at Unicode letters)."""
    return f"(?<!{WORD})(?:{pattern})(?!{WORD})"


def plain(text: Column) -> Column:
    """Lower case ASCII letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x00-\\x7F]", " ")), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Words of the plain text; an empty text has none."""
    return F.filter(F.split(plain(text), " "), lambda w: w != "")


def with_stems(words: Column) -> Column:
    """Each word and its light stems: -ing from 6 letters on, -es from 5, -s from 4."""
    stems = F.transform(
        words,
        lambda w: F.array_compact(
            F.array(
                w,
                F.when((F.length(w) > 3) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)),
                F.when((F.length(w) > 4) & w.endswith("es"), F.substr(w, F.lit(1), F.length(w) - 2)),
                F.when((F.length(w) > 5) & w.endswith("ing"), F.substr(w, F.lit(1), F.length(w) - 3)),
            )
        ),
    )
    return F.array_distinct(F.flatten(stems))


def is_noise(text: Column, stock: list[str]) -> Column:
    """A message without content: under 6 characters, a stock phrase, one word repeated, or under 3 words without a digit."""
    flat = plain(text)
    words = tokens(text)
    few = (F.size(words) < 3) & ~flat.rlike("[0-9]")
    return (F.length(flat) < 6) | flat.isin(*stock) | few | (F.size(F.array_distinct(words)) == 1)


@dataclass(frozen=True)
class Rule:
    """A lexicon entry: what it is called, what it matches, how much it weighs."""

    id: str
    pattern: str
    tier: int
    soft: bool = False


LOOK_BACK = 60


def signals(text: Column, rules: list[Rule], negation: str, hedge: str) -> Column:
    """array<struct<id, tier, soft, hedged>> of the rules found; a negation shortly before cancels one, a hedge marks it."""
    found = []
    for rule in rules:
        at = F.regexp_instr(text, F.lit(bounded(rule.pattern)))
        before = F.substring(text, F.greatest(at - LOOK_BACK, F.lit(1)), F.least(at - 1, F.lit(LOOK_BACK)))
        hit = (at > 0) & ~before.rlike(bounded(negation))
        found.append(F.when(hit, F.struct(F.lit(rule.id).alias("id"), F.lit(rule.tier).alias("tier"), F.lit(rule.soft).alias("soft"), before.rlike(bounded(hedge)).alias("hedged"))))
    return F.array_compact(F.array(*found))


def assessed_tier(found: Column) -> Column:
    """Highest tier of the signals; a soft one counts a tier less unless another signal stands beside it."""
    alone = F.size(found) < 2
    weigh = F.transform(found, lambda s: s.tier - F.when(s.soft & alone, 1).otherwise(0))
    return F.greatest(F.lit(0), F.coalesce(F.array_max(weigh), F.lit(0)))


def all_hedged(found: Column) -> Column:
    """Whether every signal of the highest tier is hedged."""
    top = F.array_max(F.transform(found, lambda s: s.tier))
    return (F.size(found) > 0) & F.forall(F.filter(found, lambda s: s.tier == top), lambda s: s.hedged)


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (label, pattern) that matches."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(bounded(pattern))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def slug(text: Column, cap: int = 48) -> Column:
    return F.substring(F.regexp_replace(plain(text), " ", "-"), 1, cap)


def masked(text: Column, pattern: str, tag: str) -> Column:
    """Every match replaced by ``[tag]``; values are never passed on."""
    return F.regexp_replace(text, pattern, f"[{tag}]")


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of every h:mm with an optional am or pm."""
    at = F.regexp_extract_all(text, F.lit("(?i)([0-2]?[0-9]):([0-5][0-9]) ?(am|pm)?"), F.lit(0))

    def minutes(s: Column) -> Column:
        hour = F.regexp_extract(s, "^([0-9]+):", 1).cast("int")
        late = s.rlike("(?i)pm$") & (hour < 12)
        early = s.rlike("(?i)am$") & (hour == 12)
        return (hour + F.when(late, 12).when(early, -12).otherwise(0)) * 60 + F.regexp_extract(s, ":([0-9]{2})", 1).cast("int")

    return F.transform(at, minutes)


def cleaned_value(text: Column) -> Column:
    """Trimmed text, null for the words that stand for no value."""
    t = F.trim(text)
    return F.when(F.lower(t).isin("", "none", "null", "unknown", "n/a", "undefined"), None).otherwise(t)


def number(text: Column) -> Column:
    """A number written with thousands separators, null if it is none."""
    return F.regexp_replace(text, "[, ]", "").try_cast("double")
