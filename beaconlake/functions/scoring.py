"""Scores of incidents, scenes and feeds as pure Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points and ceilings of the heat score by tier.
TIER_POINTS = [0, 6, 22, 45]
TIER_CEILING = [50, 62, 80, 100]
TYPICAL_SCENE_MINUTES = 25


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves upward also below zero."""
    return F.floor(x + 0.5)


def per_minute(count: Column, minutes: Column) -> Column:
    return count / F.greatest(F.lit(1.0), minutes)


def heat(units: Column, messages: Column, minutes: Column, late_units: Column, depts: Column, alarm: Column, tier: Column, hedged: Column, specialists: Column, escalations: Column, high: Column) -> Column:
    """How loud an incident is, 0 to the ceiling of its tier: volume, growth, agencies, alarms, age, language."""
    volume = F.least(F.lit(14.0), F.greatest(F.lit(0), units - 1) * 4.0) + F.least(F.lit(10.0), messages * 1.5) + F.least(F.lit(6.0), per_minute(messages, minutes) * 4)
    points = F.element_at(F.array(*map(F.lit, TIER_POINTS)), tier + 1) * F.when(hedged, 0.7).otherwise(1.0)
    total = (
        F.least(F.lit(30.0), volume)
        + F.least(F.lit(14), late_units * 5)
        + F.least(F.lit(12), F.greatest(F.lit(0), depts - 1) * 8)
        + F.least(F.lit(25), F.greatest(F.lit(0), alarm - 1) * 12)
        + F.least(F.lit(10.0), F.greatest(F.lit(0.0), (F.greatest(F.lit(1.0), minutes) - TYPICAL_SCENE_MINUTES) / 6))
        + points
        + F.least(F.lit(10), specialists * 6)
        + F.least(F.lit(8), escalations * 4)
        + F.when(high, 8).otherwise(0)
    )
    ceiling = F.element_at(F.array(*map(F.lit, TIER_CEILING)), tier + 1)
    return F.greatest(F.lit(0), F.least(ceiling, round_half_up(total)))


def severity_floor(grave: Column, heavy: Column, tier: Column, messages: Column, feeds: Column, units: Column, span: Column, fire_ops: Column, fire_nothing: Column, anomaly: Column, fleet: Column) -> Column:
    """struct(score, heard): what the evidence alone supports, 0 to 5 in halves, and how much of it was said.

    Words set the base; agencies, units, duration, crews at a fire and unusual traffic add to it.
    Without spoken evidence the score stops at 3.
    """
    base = F.when(grave > 0, 4.0).when(heavy > 0, 3.0).when(tier >= 3, 3.0).when(tier == 2, 2.0).when(messages > 0, 1.0).otherwise(0.0)
    heard = F.when(grave > 0, 4).when((heavy > 0) | (tier >= 3), 3).otherwise(0)
    s = base + F.when(feeds >= 4, 2.0).when(feeds == 3, 1.0).when((feeds == 2) & (base >= 2), 0.5).otherwise(0.0)
    s = s + F.when(units >= 8, 1.0).when(units >= 5, 0.5).otherwise(0.0)
    s = s + F.when((span >= 45) & (s >= 2), 0.5).otherwise(0.0)
    fire = (fire_ops >= 2) & ~fire_nothing
    s = F.when(fire, F.when(s < 3, 3.0).otherwise(s + 0.5) + F.when(span >= 20, 0.5).otherwise(0.0)).otherwise(s)
    heard = F.when(fire, F.greatest(heard, F.lit(3))).otherwise(heard)
    s = s + F.when(anomaly == "high", 1.5).when(anomaly == "watch", 0.75).otherwise(0.0)
    s = s + F.when(fleet == "high", 1.0).when(fleet == "watch", 0.5).otherwise(0.0)
    dark = (messages == 0) & (feeds == 0) & ((anomaly == "high") | (fleet == "high"))
    s = F.when(dark, F.greatest(s, F.lit(2.0))).otherwise(s)
    out = F.greatest(F.lit(0.0), F.least(F.lit(5.0), round_half_up(s * 2) / 2))
    return F.struct(F.when((heard == 0) & (out > 3), 3.0).otherwise(out).alias("score"), heard.alias("heard"))


def settle(floor: Column, heard: Column, model: Column) -> Column:
    """A model's score held to at most one above the floor and never below what was heard; null keeps the floor."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(5.0), x))
    return F.when(model.isNull(), floor).otherwise(clamp(F.greatest(clamp(F.least(clamp(model), clamp(floor + 1))), heard)))


def group_score(best: Column, rows: Column, tier: Column, feeds: Column) -> Column:
    """Score of a group of hits: its best, a little for its size, its tier, and for every further feed."""
    return best + F.least(F.lit(1.5), F.log2(1.0 + rows)) + F.greatest(tier, F.lit(0)) + F.least(F.lit(2), F.greatest(F.lit(0), feeds - 1))


def freshness(total: Column, offline: Column, audio_age: Column, speech_age: Column, stale: int, dark: int, quiet: int) -> Column:
    """State of a set of feeds from their ages in seconds (null: never); the first cause that holds."""
    return (
        F.when(total == 0, "dark")
        .when(audio_age.isNull() | (audio_age >= dark), "dark")
        .when(offline >= total, "dark")
        .when(offline > 0, "degraded")
        .when(audio_age >= stale, "stale")
        .when(speech_age.isNull() | (speech_age >= quiet), "quiet")
        .otherwise("live")
    )


def crowd_share(minutes: Column, length: Column, doors: float = 90.0, leaving: float = 45.0) -> Column:
    """struct(share, phase) of a crowd ``minutes`` after the start of an event of ``length`` minutes.

    It gathers to 0.85 at the start, is whole a fifth of the way in, and has gone ``leaving`` minutes after the end.
    """
    through = minutes / F.greatest(length, F.lit(1.0))
    share = (
        F.when(minutes < -doors, 0.0)
        .when(minutes < 0, 0.85 * (minutes + doors) / doors)
        .when(minutes <= length, F.when(through < 0.2, 0.85 + 0.15 * (through / 0.2)).otherwise(1.0))
        .when(minutes < length + leaving, 1 - (minutes - length) / leaving)
        .otherwise(0.0)
    )
    phase = F.when(minutes < -doors, "pending").when(minutes < 0, "building").when(minutes <= length, "peak").when(minutes < length + leaving, "dispersing").otherwise("ended")
    return F.struct(share.alias("share"), phase.alias("phase"))


def flow_multiplier(net: Column) -> Column:
    """Around 1, half up or down at most, from the net flow of docks nearby."""
    return 1 + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), net / 20))


def live_multiplier(live: Column, forecast: Column, smoothing: float = 8.0) -> Column:
    return (live + smoothing) / (F.greatest(forecast, F.lit(0)) + smoothing)


def rotated(hours: Column, by: Column) -> Column:
    """An array turned left by ``by`` places."""
    return F.concat(F.slice(hours, by + 1, F.size(hours) - by), F.slice(hours, F.lit(1), by))


def open_near(hours: Column, hour: Column) -> Column:
    """Whether any of the five circular hours around ``hour`` is above 0."""
    return F.exists(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.element_at(hours, F.pmod(hour + d, F.lit(24)) + 1) > 0)


def age_phrase(seconds: Column) -> Column:
    """A short phrase for an age: 75s, 7m, 3.5h, 2d; seconds below 90, minutes below 90, hours below 48, each rounded."""
    s = round_half_up(F.greatest(seconds, F.lit(0)))
    m = round_half_up(s / 60)
    unit = lambda x, u: F.concat(x.cast("bigint").cast("string"), F.lit(u))
    return F.when(s < 90, unit(s, "s")).when(m < 90, unit(m, "m")).when(m / 60 < 48, F.format_string("%.1fh", round_half_up(m / 6) / 10)).otherwise(unit(round_half_up(m / 1440), "d"))
