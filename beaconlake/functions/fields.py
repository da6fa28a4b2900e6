"""Fields of a place that came in the wrong place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for nothing, what a state is written as, and what joins two streets.
NOTHING = ("null", "none", "unknown", "n/a")
STATES = "^(?:ma|mass|massachusetts|usa|[0-9]{5})$"
CORNER = r"(?i)\s+(?:and|&|/|at the corner of|corner of)\s+"
NUMBERED = r"^[0-9]{1,5}[A-Za-z]?\s"


def said(value: Column) -> Column:
    """A field trimmed; null where it stands for nothing or has fewer than three characters."""
    flat = F.trim(value)
    return F.when((F.length(flat) >= 3) & ~F.lower(flat).isin(*NOTHING), flat)


def repaired(address: Column, street: Column, cross: Column, town: Column, towns: Column) -> Column:
    """struct<address, street, cross, town>: each part of a place in the field it belongs to.

    States and known ``towns`` (an array, lower case) at the end of an address leave it, the last
    town among them for an empty town; what is left without a house number is a corner if it names two streets and none is
    given, else a street if none is given; a street with a number is the address if there is none.
    A corner of one side is a street if there is neither street nor address.
    """
    parts = F.reverse(F.filter(F.transform(F.split(F.coalesce(said(address), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != ""))
    zero = F.struct(F.lit(True).alias("on"), F.lit(0).alias("gone"), F.lit(None).cast("string").alias("town"))

    def tail(a: Column, p: Column) -> Column:
        known = F.array_contains(towns, F.lower(p))
        goes = a["on"] & (F.lower(p).rlike(STATES) | known) & (a["gone"] < F.size(parts) - 1)
        return F.struct(goes.alias("on"), (a["gone"] + goes.cast("int")).alias("gone"), F.when(goes & known & a["town"].isNull(), p).otherwise(a["town"]).alias("town"))

    def split_up(cut: Column) -> Column:
        left = F.nullif(F.array_join(F.reverse(F.slice(parts, cut["gone"] + 1, F.greatest(F.size(parts), F.lit(1)))), ", "), F.lit(""))
        return F.struct(left.alias("a"), said(street).alias("s"), said(cross).alias("x"), F.coalesce(said(town), cut["town"]).alias("t"), (left.isNotNull() & ~left.rlike(NUMBERED)).alias("bare"))

    def filed(f: Column) -> Column:
        corner = f["bare"] & f["a"].rlike(CORNER) & f["x"].isNull()
        st = F.when(f["bare"] & ~corner & f["s"].isNull(), f["a"]).otherwise(f["s"])
        return F.struct(F.when(~f["bare"], f["a"]).alias("a"), st.alias("s"), F.when(corner, f["a"]).otherwise(f["x"]).alias("x"), f["t"].alias("t"))

    def mirrored(f: Column) -> Column:
        swap = f["a"].isNull() & F.coalesce(f["s"].rlike(NUMBERED), F.lit(False))
        return F.struct(F.when(swap, f["s"]).otherwise(f["a"]).alias("a"), F.when(~swap, f["s"]).alias("s"), f["x"].alias("x"), f["t"].alias("t"))

    def finished(f: Column) -> Column:
        one_sided = f["x"].isNotNull() & (F.size(F.filter(F.split(f["x"], CORNER), lambda p: F.trim(p) != "")) < 2) & f["s"].isNull() & f["a"].isNull()
        return F.struct(f["a"].alias("address"), F.when(one_sided, f["x"]).otherwise(f["s"]).alias("street"), F.when(~one_sided, f["x"]).alias("cross"), f["t"].alias("town"))

    made = F.array(F.aggregate(parts, zero, tail))
    for step in (split_up, filed, mirrored, finished):  # each step's result is computed once
        made = F.transform(made, step)
    return made.getItem(0)


def strong_unit(unit: Column) -> Column:
    """Whether a call sign says enough to be known by: a letter, or three digits."""
    return F.coalesce(unit.rlike("[A-Za-z]") | (F.length(F.regexp_replace(unit, "[^0-9]", "")) >= 3), F.lit(False))
