"""Questions to the archive: what a short text asks for, and the score of a call against it.

A question is read once, on the driver; what it asks becomes Columns.  Time is read by a small
grammar over the words: a day, a part of it, a number of units, a date.  What else can be asked for
is given as a :class:`Vocabulary`.
"""

from __future__ import annotations

import re
from calendar import day_name, month_abbr, month_name
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.functions import geo
from beaconlake.functions import text as tx

ZONE = ZoneInfo("America/New_York")
HOUR = timedelta(hours=1)

# The hours of the parts of a day, the longest length, and the window of a question that names none.
PARTS = {"morning": (0, 12), "afternoon": (12, 18), "evening": (18, 30), "night": (18, 30)}
LONGEST = timedelta(days=30)
UNNAMED = timedelta(days=2)

_DAYS = [d.lower() for d in day_name]
_MONTHS = [m.lower() for m in month_abbr]
_UNITS = {"min": HOUR / 60, "minute": HOUR / 60, "hr": HOUR, "hour": HOUR, "day": 24 * HOUR, "week": 7 * 24 * HOUR, "month": LONGEST}
_NUMBERS = {w: n for n, w in enumerate("no one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1, "couple": 2, "few": 3, "several": 4}
_BACK = {"last", "past", "previous"}
_TOKEN = re.compile(r"\d{4}-\d\d-\d\d|\d+/\d+(?:/\d+)*|\d+[a-z]*|[a-z]+")


@dataclass(frozen=True)
class Span:
    """A window of time: whether it was named, and what it is called."""

    start: datetime
    end: datetime
    label: str
    named: bool = True


@dataclass(frozen=True)
class Place:
    """A place of the vocabulary: the names it goes by, its point and how far it reaches."""

    names: tuple[str, ...]
    lat: float
    lon: float
    metres: float


@dataclass(frozen=True)
class Vocabulary:
    """What questions name besides time.

    ``kinds``: a pattern for each kind of call, those that hold first before others; ``kin``: kinds
    that a call of another kind may stand for; ``big``: pattern of words that ask for the serious ones;
    ``suffixes``: the last word of a street's name and how it is cut short; ``filler``: words that ask for nothing.
    """

    kinds: Mapping[str, str] = field(default_factory=dict)
    kin: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    big: str = r"(?!)"
    suffixes: Mapping[str, str] = field(default_factory=dict)
    filler: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Asked:
    """A parsed question."""

    span: Span
    kind: str | None = None
    landmark: Place | None = None
    place: Place | None = None
    phrases: tuple[tuple[str, ...], ...] = ()
    words: tuple[str, ...] = ()
    big: bool = False
    vocabulary: Vocabulary = Vocabulary()

    @property
    def count(self) -> int:
        return sum(x is not None for x in (self.kind, self.landmark, self.place)) + len(self.phrases) + len(self.words)


class _Clock:
    """Days and lengths counted from one instant in ZONE."""

    def __init__(self, now: datetime):
        self.now = now.astimezone(ZONE)

    def hours(self, day: datetime, first: int, last: int) -> tuple[datetime, datetime]:
        """Hours of a local day, beyond 24 those of the next, whatever the clocks do in it."""
        at = lambda h: datetime.combine(day.date() + timedelta(days=h // 24), time(h % 24), ZONE)
        return at(first), at(last)

    def back(self, days: int) -> datetime:
        return self.now - timedelta(days=days)

    def length(self, span: timedelta, label: str) -> Span:
        """The time up to now, of so many seconds."""
        start = (self.now.astimezone(timezone.utc) - span).astimezone(ZONE)
        return Span(start, self.now, label)

    def day(self, back: int, label: str, part: str = "") -> Span:
        """A day or a part of it."""
        return Span(*self.hours(self.back(back), *PARTS.get(part, (0, 24))), label)

    def so_far(self, span: Span) -> Span:
        """A window up to now, if now is in it."""
        return Span(span.start, self.now if span.start <= self.now < span.end else span.end, span.label)

    def date(self, year: int, month: int, day: int, label: str | None = None) -> Span:
        """A date; a day past the end of its month runs on into the next."""
        start, end = self.hours(datetime(year, month, 1, tzinfo=ZONE) + timedelta(days=day - 1), 0, 24)
        return Span(start, end, label or f"{_MONTHS[month]} {day}")

    def recent_date(self, month: int, day: int) -> Span:
        """The latest date of a month and day that is not ahead."""
        return self.date(self.now.year - ((month, day) > (self.now.month, self.now.day)), month, day)

    def recent_number(self, day: int) -> Span:
        """The latest day of this number, of this month or the last."""
        month = self.now if day <= self.now.day else self.now.replace(day=1) - timedelta(days=1)
        return self.date(month.year, month.month, day)

    def night(self) -> Span:
        """The night that began yesterday."""
        return Span(*self.hours(self.back(1), *PARTS["night"]), "last night")

    def tonight(self) -> Span:
        """The night that is on; by day the one that was."""
        if self.now.hour >= 18:
            return Span(*self.hours(self.now, *PARTS["night"]), "tonight")
        return Span(self.night().start, self.night().end, "tonight" if self.now.hour < 6 else "last night")


def _day_number(word: str, bare: bool) -> int | None:
    m = re.fullmatch(r"(\d{1,2})(st|nd|rd|th)?", word)
    return int(m[1]) if m and 1 <= int(m[1]) <= 31 and (m[2] or bare) else None


def _length(words: list[str], clock: _Clock) -> Span | None:
    """``last 6 hours``, ``past couple of days``, ``last week``: the words behind the first."""
    rest = words[1:5]
    amount, said = 1, []
    if rest and (rest[0].isdigit() and len(rest[0]) <= 3 or rest[0] in _NUMBERS):
        amount = int(rest[0]) if rest[0].isdigit() else _NUMBERS[rest[0]]
        said, rest = rest[:1], rest[1:]
        if rest[:1] == ["of"] and said == ["couple"]:
            said, rest = [*said, "of"], rest[1:]
    unit = _UNITS.get(rest[0].removesuffix("s")) if rest else None
    if unit is None:
        return None
    span = min(LONGEST, max(HOUR / 60, amount * unit))
    if (amount, rest[0]) in ((7, "days"), (30, "days")):
        return clock.length(span, "the last week" if amount == 7 else "the last month")
    return clock.length(span, " ".join(["the last", *said, rest[0]]))


def _readings(words: list[str], clock: _Clock) -> Iterator[tuple[int, Span]]:
    """Every time that the words name, with how little it says: 0 a part of a day, a length or a date, 1 a day, 2 a name that recurs."""
    for i, word in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        if word == "overnight" or (word in ("last", "yesterday") and after == "night"):
            yield 0, clock.night()
        elif word == "tonight" or (word, after) == ("this", "evening"):
            yield 0, clock.tonight()
        elif word in ("yesterday", "this") and after in PARTS:
            yield 0, clock.so_far(clock.day(int(word == "yesterday"), f"{word} {after}", after))
        elif word == "yesterday":
            yield 1, clock.day(1, word)
        elif word in ("today", "midnight"):
            yield 1, clock.so_far(clock.day(0, "today"))
        elif word == "weekend":
            saturday = clock.back((clock.now.weekday() - _DAYS.index("saturday")) % 7)
            yield 1, clock.so_far(Span(*clock.hours(saturday, 0, 48), "the weekend"))
        elif word in _BACK and (span := _length(words[i:], clock)):
            yield 0, span
        elif word == "currently" or (word, after) in (("right", "now"), ("still", "going"), ("the", "moment")):
            yield 0, clock.length(HOUR, "the last hour")
        elif m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", word):
            if 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31:
                yield 0, clock.date(int(m[1]), int(m[2]), int(m[3]), word)
        elif m := re.fullmatch(r"(\d{1,2})/(\d{1,2})", word):
            if 1 <= int(m[1]) <= 12 and 1 <= int(m[2]) <= 31:
                yield 0, clock.recent_date(int(m[1]), int(m[2]))
        elif word[:3] in _MONTHS[1:] and (day := _day_number(after, bare=True)):
            yield 0, clock.recent_date(_MONTHS.index(word[:3]), day)
        elif (day := _day_number(word, bare=False)) and words[i - 1][:3] not in _MONTHS[1:]:
            yield 1, clock.recent_number(day)
        elif word in _DAYS:
            yield 2, clock.day((clock.now.weekday() - _DAYS.index(word)) % 7, word)


def time_span(question: str, now: datetime) -> Span:
    """The window a question names: of all it names the one that says most, the first of equals; without one the last two days, not named.

    A night runs from 18 to 6 local time; a date later in the year than today is last year's, a day
    number later than today last month's.  A weekday is the latest, today's included.
    """
    clock = _Clock(now)
    found = sorted(_readings(_TOKEN.findall(question.lower()), clock), key=lambda x: x[0])
    if found:
        return found[0][1]
    unnamed = clock.length(UNNAMED, "the last two days")
    return Span(unnamed.start, unnamed.end, unnamed.label, named=False)


_MOMENTS = frozenset("ago currently earlier midnight moment now overnight since today tonight weekend yesterday".split())


def _says_when(word: str) -> bool:
    """Whether a word only tells time: a unit, a number, a name of a day or month, or their like."""
    one = word.removesuffix("s")
    month = any(name.lower().startswith(word) and len(word) >= 3 for name in month_name[1:]) or word == "sept"
    return one in _UNITS or one in _NUMBERS or word in _BACK or word in PARTS or word in _DAYS or word in _MOMENTS or month or word.isdigit() or _day_number(word, bare=True) is not None


def parse(question: str, now: datetime, places: list[Place] = (), landmarks: list[Place] = (), vocabulary: Vocabulary = Vocabulary()) -> Asked:
    """What a question asks for: window, kind, landmark, place, named streets, up to eight words, and whether the big ones are wanted.

    Whatever names a thing is used up by it: a landmark takes the place it lies in, a name with its
    suffix is one phrase in both spellings, and words of time, kind or size are no search words.
    """
    lower = question.lower()
    tokens = re.findall("[a-z0-9]+", lower)
    flat = f" {' '.join(tokens)} "
    said = {kind: m for kind, pattern in vocabulary.kinds.items() if (m := re.search(rf"\b(?:{pattern})\b", lower))}
    kind = next(iter(said), None)
    named = lambda known: next(((p, n) for p in known for n in p.names if f" {n} " in flat), (None, ""))
    (landmark, as_landmark), (place, as_place) = named(landmarks), named(places)
    if landmark and any(as_place and as_place in n for n in landmark.names):
        place, as_place = None, ""
    used = {*as_landmark.split(), *as_place.split(), *(said[kind][0].split() if kind else ())}
    big = re.compile(vocabulary.big)

    def asks(word: str) -> bool:
        of_kind = kind is not None and re.fullmatch(vocabulary.kinds[kind], word)
        return len(word) > 2 and not (word in used or word in vocabulary.filler or word in vocabulary.suffixes or of_kind or big.fullmatch(word) or _says_when(word))

    streets = [(a, b) for a, b in zip(tokens, tokens[1:]) if b in vocabulary.suffixes and asks(a)]
    spent = {w for street in streets for w in street}
    words = list(dict.fromkeys(w for w in tokens if w not in spent and asks(w)))
    phrases = tuple(tuple(dict.fromkeys((f"{a} {b}", f"{a} {vocabulary.suffixes[b]}"))) for a, b in streets)
    return Asked(time_span(question, now), kind, landmark, place, phrases, tuple(words[:8]), any(map(big.fullmatch, tokens)), vocabulary)


def score(asked: Asked, *, hay: Column, words: Column, label: Column, lat: Column, lon: Column, vague: Column, high: Column, tier: Column, alarm: Column) -> Column:
    """Points of a call for a question, 0 where it is no answer.

    The declared kind counts 10, the kind in the text 5, a kin kind 1 beside something named; a
    landmark 7 said or 6 nearby, a place 5 or 4, a phrase 8, a word 3, a word one edit away 2; the
    share of what was asked multiplies.  A call that names none of the named things is no answer.
    """
    # The points.
    zero, one = F.lit(0.0), F.lit(1)
    serious = F.when(high, 3).otherwise(0) + F.when(tier >= 2, 2).otherwise(0) + F.when(alarm > 0, 2).otherwise(0)
    if not asked.count:
        return one + (serious + F.when(tier >= 3, 2).otherwise(0) if asked.big else F.lit(0)) + zero
    points, hits, named, ok, kin = F.lit(0), F.lit(0), F.lit(0), F.lit(True), F.lit(False)
    if asked.kind:
        pattern = tx.bounded(asked.vocabulary.kinds[asked.kind])
        own, said = (label == asked.kind) | F.coalesce(label.rlike(pattern), F.lit(False)), hay.rlike(pattern)
        related = F.coalesce(label.isin(*asked.vocabulary.kin.get(asked.kind, ("",))), F.lit(False)) & ~own & ~said
        points, hits, kin, ok = points + F.when(F.coalesce(own, F.lit(False)), 10).when(said, 5).otherwise(0), hits + F.when(F.coalesce(own, F.lit(False)) | said, 1).otherwise(0), related, F.coalesce(own, F.lit(False)) | said | related
    for thing, spoken, nearby in ((asked.landmark, 7, 6), (asked.place, 5, 4)):
        if thing:
            said = F.exists(F.array(*map(F.lit, thing.names)), lambda n: F.contains(hay, n))
            close = (geo.metres(lat, lon, F.lit(thing.lat), F.lit(thing.lon)) <= thing.metres) & (~vague if spoken == 5 else F.lit(True))
            points, ok = points + F.when(said, spoken).when(close, nearby).otherwise(0), ok & (said | close)
            hits, named = hits + F.when(said | close, 1).otherwise(0), named + F.when(said | close, 1).otherwise(0)
    for phrase in asked.phrases:
        said = F.exists(F.array(*map(F.lit, phrase)), lambda p: F.contains(hay, p))
        points, hits, named = points + F.when(said, 8).otherwise(0), hits + said.cast("int"), named + said.cast("int")
    for word in asked.words:
        said = F.arrays_overlap(words, F.array(*map(F.lit, (word, word + "s", word + "es"))))
        near = F.exists(words, lambda w: (F.substring(w, 1, 1) == word[0]) & (F.abs(F.length(w) - len(word)) <= 1) & (F.levenshtein(w, F.lit(word), 1) == 1)) if len(word) >= 6 else F.lit(False)
        points = points + F.when(said, 3).when(near, 2).otherwise(0)
        hits, named = hits + F.when(said | near, 1).otherwise(0), named + F.when(said | near, 1).otherwise(0)
    specific = bool(asked.phrases or asked.words or asked.landmark or asked.place)
    ok = ok & (~kin | (named > 0)) & ((named > 0) if specific else F.lit(True)) & (hits > 0)
    points = points + kin.cast("int") + (serious if asked.big else F.lit(0))
    return F.when(ok, points * (one + hits / F.lit(float(asked.count)))).otherwise(zero)
