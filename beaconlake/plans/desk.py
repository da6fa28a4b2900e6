"""Queries of the desk: audits, boards, packing and sampling, list operations, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.functions import localtime
from beaconlake.functions import text as tx
from beaconlake.operators import ordered
from beaconlake.plans.calls import CALLS_SQL, calls
from beaconlake.plans.core import Query
from beaconlake.sources.tables import MESSAGES_SQL as M
from beaconlake.sources.tables import messages, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
NOW = 1_706_572_800_000_000


def orphan_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Clips (clicks) that no call of their unit refers to from the day before to the day after, by feed and hour."""
    m = messages(spark, sf).withColumn("day", F.floor(F.col("at_us") / DAY))
    calls_ = m.filter("call_type != 'click'").select("unit", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)).alias("day")).distinct()
    orphans = m.filter("call_type = 'click'").join(calls_, ["unit", "day"], "left_anti")
    return orphans.groupBy("feed", localtime.hour_key(F.col("at")).alias("hour")).agg(F.count("*").alias("orphans"), F.min("event_id").alias("first_id"))


def lateness_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Batches (feed and hour) written over 15 minutes after their first row, the twelve worst."""
    b = messages(spark, sf).groupBy("feed", F.floor(F.col("at_us") / HOUR).alias("hour")).agg(F.min("at_us").alias("first_us"), F.max("at_us").alias("written_us"), F.count("*").alias("n"))
    late = b.withColumn("late_s", F.round((F.col("written_us") - F.col("first_us")) / 1e6, 3)).filter("late_s > 900")
    return late.orderBy(F.desc("late_s"), "feed", "hour").limit(12).select("feed", "hour", "late_s", "n")


def arrival_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each feed, and arrivals an hour and a day over the span of all rows; a span under a minute gives none."""
    m = messages(spark, sf)
    whole = m.agg(F.count("*").alias("all"), ((F.max("at_us") - F.min("at_us")) / 3.6e9).alias("hours"))
    each = m.groupBy("feed").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))  # one row
    rate = F.when(F.col("hours") >= 1 / 60, F.col("n") / F.col("hours"))
    return each.select("feed", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), F.round(rate, 6).alias("per_hour"), F.round(rate * 24, 6).alias("per_day"))


def boards(spark: SparkSession, sf: str) -> DataFrame:
    """The first 40 orders of three boards: incidents (open first, newest), situations (closed last, high first, newest), desk (high first, then open, newest)."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("closed"), (~F.col("o_orderpriority").startswith("1")).cast("int").alias("low"), F.unix_micros("o_orderdate").alias("at_us"))
    orders = {"incidents": ["closed"], "situations": ["closed", "low"], "desk": ["low", "closed"]}
    parts = []
    for name, keys in orders.items():
        order = [*keys, F.desc("at_us"), "o_orderkey"]
        top = o.orderBy(*order).limit(40).select(F.lit(name).alias("board"), "o_orderkey", *keys, "at_us")
        parts.append(ordered.ordered_rank(top, order).select("board", "o_orderkey", "place"))  # 40 rows
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def slim_timelines(spark: SparkSession, sf: str) -> DataFrame:
    """The last 10 lines of each open customer (balance not below 0) or 3 of each other, and how many there were."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") >= 0).alias("open")), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("o_custkey")
    ranked = o.withColumn("_r", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).withColumn("_n", F.count("*").over(w))
    kept = ranked.filter(F.col("_r") <= F.when(F.col("open"), 10).otherwise(3))
    return kept.groupBy("o_custkey").agg(F.max("_n").alias("timeline_total"), F.count("*").alias("kept"), F.min("o_orderkey").alias("least_key"))


def capped_log(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 25 entries of each kind that are not older than ten days."""
    m = messages(spark, sf).filter(F.col("at_us").between(NOW - 10 * DAY, NOW)).select("call_type", "event_id", "at_us")
    return ordered.last_n(m, ["call_type"], [F.desc("at_us"), F.desc("event_id")], 25)


def fitted(each: Column, budget: int, rounds: int = 40) -> Column:
    """An array of structs with a list ``events``, the first halves of whose longest lists are cut until its JSON has at most ``budget`` characters.

    Of lists of one length the first is cut; a list of one event stays.
    """
    sizes = lambda a: F.transform(a, lambda e: F.size(e["events"]))

    def step(a: Column, _: Column) -> Column:
        longest = F.array_position(sizes(a), F.array_max(sizes(a))).cast("int") - 1
        cut = lambda e: e.withField("events", F.slice(e["events"], F.ceil(F.size(e["events"]) / 2).cast("int") + 1, F.size(e["events"])))
        return F.when((F.length(F.to_json(a)) <= budget) | (F.array_max(sizes(a)) < 2), a).otherwise(F.transform(a, lambda e, i: F.when(i == longest, cut(e)).otherwise(e)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), each, step)


BUDGET = 1200


def trimmed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Per day the events of its feeds, the oldest of the longest cut until the day's JSON has at most BUDGET characters."""
    n = messages(spark, sf).groupBy(F.floor(F.col("at_us") / DAY).alias("day"), "feed").agg(F.array_sort(F.collect_list(F.struct("at_us", "event_id"))).alias("e"))
    days = n.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("feed", F.transform("e", lambda x: x["event_id"].cast("string")).alias("events")))).alias("each"))  # a row per feed
    kept = days.select("day", F.explode(F.array(fitted(F.col("each"), BUDGET))).alias("kept"))
    return kept.select("day", F.to_json("kept").alias("json"), F.length(F.to_json("kept")).alias("chars"))


def change_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Reports whose sorted fields differ from the report before of the same unit, or come 45 hours or more after it."""
    fields = F.sha2(F.concat_ws("|", F.array_sort(F.array(F.concat(F.lit("feed="), "feed"), F.concat(F.lit("kind="), "call_type"), F.concat(F.lit("live="), (F.col("k") >= 50).cast("string"))))), 256)
    w = Window.partitionBy("unit").orderBy("at_us", "event_id")
    m = messages(spark, sf).withColumn("sig", F.substring(fields, 1, 12))
    m = m.withColumn("_s", F.lag("sig").over(w)).withColumn("_a", F.lag("at_us").over(w))
    return m.filter(F.col("_s").isNull() | (F.col("_s") != F.col("sig")) | (F.col("at_us") - F.col("_a") >= 45 * HOUR)).select("unit", "event_id", "sig")


def spread_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.thin_tail(messages(spark, sf).select("event_id", "at_us"), 200, 0.35, "at_us", "event_id")


def scene_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each unit up to six: its first, those that match (k from 90 on), its last, then by evidence."""
    w = Window.partitionBy("unit")
    m = messages(spark, sf).select("unit", "event_id", "at_us", "k")
    m = m.withColumn("_f", F.row_number().over(w.orderBy("at_us", "event_id"))).withColumn("_l", F.row_number().over(w.orderBy(F.desc("at_us"), F.desc("event_id"))))
    band = F.when(F.col("_f") == 1, 0).when(F.col("k") >= 90, 1).when(F.col("_l") == 1, 2).otherwise(3)
    return ordered.last_n(m, ["unit"], [band, F.desc("k"), F.col("event_id")], 6).select("unit", "event_id", band.alias("band"))


def block_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Lines each block (conversation, in order) of a session of 40 may show: what is left of 150, two at least."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("lines")).withColumn("session", F.floor(F.col("conv_id") / 40))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("session").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "lines", F.least(F.col("lines"), F.greatest(F.lit(2), 150 - before)).cast("bigint").alias("shown"))


def list_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of a unit's early and late calls as ordered lists: their union, the union capped at three, common and undone entries, compatibility."""
    m = messages(spark, sf).withColumn("late", F.col("at_us") >= NOW - 12 * DAY)
    first = m.groupBy("unit", "late", "call_type").agg(F.min(F.struct("at_us", "event_id")).alias("f"))
    side = lambda late: F.transform(F.array_sort(F.collect_list(F.when(F.col("late") == late, F.struct("f", "call_type")))), lambda x: x.call_type)  # noqa: E731  at most a row per kind
    u = first.groupBy("unit").agg(side(False).alias("a"), side(True).alias("b"))
    union = F.array_union("a", "b")
    return u.select(
        "unit", F.array_join(union, ",").alias("merged"), F.array_join(F.slice(union, 1, 3), ",").alias("capped"), F.size(F.array_intersect("a", "b")).alias("common"),
        F.array_join(F.array_except(union, "b"), ",").alias("undone"), ((F.size("a") == 0) | (F.size("b") == 0) | F.arrays_overlap("a", "b")).alias("compatible"),
    )


#: Words of our own that stand for the same thing.
SYNONYMS = {"the": ("der", "les", "los"), "and": ("und", "et"), "tion": ("cion", "ung")}
WORDS = ("the", "and", "tion", "thonin", "eses")


def has_word(words: Column, word: str) -> Column:
    """Whether a list of words has one, give or take a plural."""
    # Which endings count as a plural.
    tried = [word, word + "s"] + ([word + "es"] if len(word) > 2 else []) + ([word[:-2]] if len(word) > 3 and word.endswith("es") else []) + ([word[:-1]] if len(word) > 3 and word.endswith("s") else [])
    return F.arrays_overlap(words, F.array(*map(F.lit, tried)))


def word_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Items that say each word or one that stands for it, or at least a word of six letters one edit away."""
    d = table(spark, sf, "benchmark").select("item_id", tx.with_stems(tx.tokens(F.col("text"))).alias("w"))
    said = [F.when(has_word(F.col("w"), word) | F.arrays_overlap("w", F.array(*map(F.lit, SYNONYMS.get(word, ("",))))), word) for word in WORDS]
    near = F.exists("w", lambda x: (F.substring(x, 1, 1) == "t") & (F.abs(F.length(x) - 6) <= 1) & (F.levenshtein(x, F.lit("thonin"), 1) == 1))
    return d.select("item_id", F.array_join(F.array_compact(F.array(*said)), ",").alias("said"), near.alias("near"))


def _said_sql() -> str:
    def tried(word: str) -> list[str]:
        return [word, word + "s"] + ([word + "es"] if len(word) > 2 else []) + ([word[:-2]] if len(word) > 3 and word.endswith("es") else []) + ([word[:-1]] if len(word) > 3 and word.endswith("s") else []) + list(SYNONYMS.get(word, ()))

    return ", ".join(f"CASE WHEN list_has_any(w, [{', '.join(repr(x) for x in tried(word))}]) THEN '{word}' END" for word in WORDS)


_PLAIN = "trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_PLAIN}, ' '), lambda w: w <> '')"
_STEMMED = f"""list_distinct(flatten(list_transform({_TOKENS}, lambda x: [x, CASE WHEN length(x) > 3 AND x LIKE '%s' THEN left(x, length(x) - 1) ELSE x END, CASE WHEN length(x) > 4 AND x LIKE '%es' THEN left(x, length(x) - 2) ELSE x END, CASE WHEN length(x) > 5 AND x LIKE '%ing' THEN left(x, length(x) - 3) ELSE x END])))"""


def departments(spark: SparkSession, sf: str) -> DataFrame:
    """Service and town of feeds by their labels."""
    label = F.element_at(F.array(*map(F.lit, ("_fire", " PD", " EMS dispatch", "-police scanner", ""))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    d = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lower(F.translate("n_name", "_0123456789", " abcdefghij")), label).alias("raw"))
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"[_\-.]+", " "), r"\s+", " "))
    service = F.when(s.rlike(r"fire|\bfd\b"), "Fire").when(s.rlike(r"\bems\b|ambulance"), "EMS").when(s.rlike(r"police|\bpd\b"), "Police")
    town = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(s, r"fire|police|ambulance|scanner|dispatch|\b(?:ems|fd|pd)\b", " "), r"\s+", " ")))
    return d.select("n_nationkey", F.when(service.isNull(), town).otherwise(F.concat(town, F.lit(" "), service)).alias("dept"))


def local_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Clock, stamp and day of every message in the newsroom's zone, and whether a day written by hand exists."""
    m = messages(spark, sf)
    at = localtime.local(F.col("at"))
    written = F.format_string("2023-%02d-%02d", F.col("event_id") % 13, F.col("event_id") % 32)
    return m.select("event_id", F.date_format(at, "HH:mm").alias("clock"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("stamp"), localtime.is_calendar_day(written).alias("exists"))


_LOCAL = """timezone('America/New_York', timezone('UTC', "at"))"""


def alert_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Alert keys: kind and a cell of a hundredth of a degree, else the kind and a slug of the place, else the first six telling words."""
    c = calls(spark, sf)
    cell = F.concat(F.format_string("%.2f", "lat"), F.lit(","), F.format_string("%.2f", "lon"))
    stop = ("the", "a", "an", "at", "in", "on", "of", "to", "and", "for", "with", "is", "are", "after", "near")
    words = F.slice(F.filter(tx.tokens(F.col("text")), lambda w: ~w.isin(*stop)), 1, 6)
    key = F.when(F.col("k") >= 60, cell).when(F.col("k") >= 30, tx.slug(F.col("street"))).otherwise(F.concat(F.lit("nowhere|"), F.array_join(words, "-")))
    return c.groupBy(F.concat(F.lower("call_type"), F.lit("|"), key).alias("alert_key")).agg(F.count("*").alias("n"), F.min("at_us").alias("first_us"))


_STOP = "'the', 'a', 'an', 'at', 'in', 'on', 'of', 'to', 'and', 'for', 'with', 'is', 'are', 'after', 'near'"


def scene_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each street's day from the words that fell, the first that holds."""
    said = lambda p: F.max(F.col("text").rlike(rf"\b(?:{p})\b"))
    g = calls(spark, sf).groupBy("street", F.floor(F.col("at_us") / DAY).alias("day")).agg(said("shots|stabbing|gun").alias("crime"), said("fire|alarm").alias("fire"), said("pursuit|fleeing").alias("chase"), said("medical").alias("medical"), said("crash").alias("crash"))
    kind = F.when(F.col("crime"), "crime").when(F.col("fire"), "fire").when(F.col("chase"), "chase").when(F.col("medical"), "medical").when(F.col("crash"), "crash").otherwise("other")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("scenes"))


def call_log(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by role: how many, how many failed (no text), mean and longest time by length."""
    c = table(spark, sf, "conversations").withColumn("ms", F.coalesce(F.char_length("text"), F.lit(0)) * 3 + F.col("turn"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.char_length("text"), F.lit(0)) < 30).alias("failed"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.max("ms").alias("most_ms"))


def published_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of an archive as rows (name, value): size, distinct feeds and units, share with a label, rate a year, the most repeated unit."""
    m = messages(spark, sf)
    a = m.agg(F.count("*").alias("rows"), F.countDistinct("feed").alias("feeds"), F.countDistinct("unit").alias("units"), F.count_if(F.col("k") >= 50).alias("labelled"), ((F.max("at_us") - F.min("at_us")) / DAY).alias("days"))
    top = m.groupBy("unit").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    one = a.crossJoin(F.broadcast(top))  # one row each
    d = lambda c: F.round(c.cast("double"), 6)
    pairs = [("rows", d(F.col("rows"))), ("feeds", d(F.col("feeds"))), ("units", d(F.col("units"))), ("labelled_pct", d(F.col("labelled") / F.col("rows") * 100)), ("per_year", d(F.col("rows") / F.col("days") * 365)), ("most_repeats", d(F.col("most")))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])).alias("x")).select("x.name", "x.value")


def cleaned_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without bracketed tags; junk and lines of two different words or fewer (of three letters) go, unless they carry a fact."""
    c = calls(spark, sf).withColumn("t", F.trim(F.regexp_replace(F.concat(F.lit("[static] "), "text"), r"\[[^\]]*\]|\([^)]*\)", " ")))
    words = F.array_distinct(F.filter(tx.tokens(F.col("t")), lambda w: F.length(w) >= 3))
    fact = F.col("t").rlike(r"\b[0-9]{1,5} [a-z]+ (?:street|road|avenue|lane|square)\b|traffic stop")
    junk = F.col("t").isin("test test test", "thank you", "copy") | (F.size(words) <= 2)
    return c.withColumn("kept", ~junk | fact).groupBy("kept", fact.alias("fact")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def startable(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that may open an incident: a place that is not vague, not a stop, not inherited, and a dispatcher or a venue behind it."""
    c = calls(spark, sf)
    exact = F.col("k") >= 50
    venue = F.col("street").rlike("square$")
    stop = F.col("text").contains("traffic stop")
    dispatch = F.col("text").rlike(r"\b(?:respond|strike|report)\b")
    ok = (exact | venue) & ~stop & (dispatch | venue | (F.col("k") >= 90))
    return c.filter(ok).select("event_id", exact.alias("exact"), venue.alias("venue"), dispatch.alias("dispatch"))


def feed_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of each unit that are on the list of feeds, whatever their case, once each and six at most."""
    m = messages(spark, sf).select("unit", F.upper("feed").alias("tag"), "at_us", "event_id")
    known = table(spark, sf, "nation").filter("n_nationkey < 15").select(F.concat(F.lit("feed-"), F.col("n_nationkey").cast("string")).alias("feed"))
    first = m.join(known, F.lower("tag") == F.col("feed"), "left_semi").groupBy("unit", F.lower("tag").alias("tag")).agg(F.min(F.struct("at_us", "event_id")).alias("f"))
    kept = ordered.last_n(first, ["unit"], [F.col("f"), F.col("tag")], 6)
    return kept.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", "tag"))), lambda x: x.tag), ",").alias("tags"))


def loud_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of two samples (line numbers of an order) whose root mean square is at the gate or above, with one window kept either side."""
    s = table(spark, sf, "lineitem").select("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).alias("w"), (F.col("l_discount") - 0.05).alias("x"))
    r = s.groupBy("l_orderkey", "w").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    loud = r.filter(F.round("rms", 9) >= 0.03).groupBy("l_orderkey").agg(F.min("w").alias("first"), F.max("w").alias("last"))
    return loud.select("l_orderkey", F.greatest(F.lit(0), F.col("first") - 1).cast("bigint").alias("from_w"), (F.col("last") + 1).cast("bigint").alias("to_w"))


def rollup_names(spark: SparkSession, sf: str) -> DataFrame:
    """Day, hour and time of writing read back from the paths of rollups."""
    path = F.concat(F.date_format("at", "'roll/'yyyy-MM-dd'/'HH'/'"), F.col("at_us").cast("string"), F.lit(".json"))
    m = messages(spark, sf).select("event_id", path.alias("path"))
    part = lambda p: F.regexp_extract("path", p, 1)
    return m.select("event_id", part(r"roll/([0-9-]+)/").alias("day"), part(r"/([0-9]{2})/").cast("int").alias("hour"), part(r"/([0-9]+)\.json$").cast("bigint").alias("written"))


QUERIES: dict[str, Query] = {
    "orphan_audit": Query(
        orphan_audit, ("A1",),
        f"""WITH {M}, m AS (SELECT *, at_us // {DAY} AS day FROM messages)
        SELECT feed, strftime({_LOCAL}, '%H') AS hour, count(*) AS orphans, min(event_id) AS first_id FROM m WHERE call_type = 'click' AND NOT EXISTS (SELECT 1 FROM m c WHERE c.unit = m.unit AND c.call_type <> 'click' AND abs(c.day - m.day) <= 1) GROUP BY 1, 2""",
    ),
    "lateness_audit": Query(
        lateness_audit, ("A2",),
        f"WITH {M}, b AS (SELECT feed, at_us // {HOUR} AS hour, round((max(at_us) - min(at_us)) / CAST(1000000 AS DOUBLE), 3) AS late_s, count(*) AS n FROM messages GROUP BY 1, 2) SELECT * FROM b WHERE late_s > 900 ORDER BY late_s DESC, feed, hour LIMIT 12",
    ),
    "arrival_projection": Query(
        arrival_projection, ("A4", "W8"),
        f"""WITH {M}, a AS (SELECT count(*) AS total, (max(at_us) - min(at_us)) / CAST(3600000000 AS DOUBLE) AS hours FROM messages)
        SELECT feed, count(*) AS n, round(count(*) / CAST(any_value(total) AS DOUBLE), 6) AS share, round(count(*) / any_value(hours), 6) AS per_hour, round(count(*) / any_value(hours) * 24, 6) AS per_day FROM messages, a GROUP BY feed""",
    ),
    "boards": Query(
        boards, ("O1", "O2", "A5"),
        "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END AS low, epoch_us(o_orderdate) AS at_us FROM orders)"
        + " UNION ALL ".join(f" SELECT * FROM (SELECT '{b}' AS board, o_orderkey, row_number() OVER (ORDER BY {k}, at_us DESC, o_orderkey) AS place FROM o) WHERE place <= 40" for b, k in (("incidents", "closed"), ("situations", "closed, low"), ("desk", "low, closed"))),
    ),
    "slim_timelines": Query(
        slim_timelines, ("K5",),
        """WITH r AS (SELECT o_custkey, o_orderkey, c_acctbal >= 0 AS open, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT o_custkey, max(n) AS timeline_total, count(*) AS kept, min(o_orderkey) AS least_key FROM r WHERE r <= CASE WHEN open THEN 10 ELSE 3 END GROUP BY 1""",
    ),
    "capped_log": Query(capped_log, ("K9",), f"WITH {M} SELECT call_type, event_id, at_us, row_number() OVER (PARTITION BY call_type ORDER BY at_us DESC, event_id DESC) AS back FROM messages WHERE at_us BETWEEN {NOW - 10 * DAY} AND {NOW} QUALIFY back <= 25"),
    "trimmed_events": Query(
        trimmed_events, ("K6",),
        f"""WITH RECURSIVE {M}, f AS (SELECT at_us // {DAY} AS day, feed, list(CAST(event_id AS VARCHAR) ORDER BY at_us, event_id) AS events FROM messages GROUP BY ALL),
        d AS (SELECT day, list({{'feed': feed, 'events': events}} ORDER BY feed) AS kept FROM f GROUP BY day),
        r AS (SELECT day, kept, 0 AS pass FROM d UNION ALL SELECT day, list_transform(kept, lambda e, i: CASE WHEN i = list_position(sizes, list_max(sizes)) THEN {{'feed': e.feed, 'events': e.events[CAST(ceil(len(e.events) / CAST(2 AS DOUBLE)) AS BIGINT) + 1 :]}} ELSE e END), pass + 1
          FROM (SELECT *, list_transform(kept, lambda e: len(e.events)) AS sizes FROM r) WHERE pass < 40 AND length(CAST(to_json(kept) AS VARCHAR)) > {BUDGET} AND list_max(sizes) > 1)
        SELECT day, CAST(to_json(kept) AS VARCHAR) AS json, CAST(length(json) AS INT) AS chars FROM r QUALIFY row_number() OVER (PARTITION BY day ORDER BY pass DESC) = 1""",
    ),
    "change_gate": Query(
        change_gate, ("B19",),
        f"""WITH {M}, s AS (SELECT unit, event_id, at_us, left(sha256('feed=' || feed || '|kind=' || call_type || '|live=' || CASE WHEN k >= 50 THEN 'true' ELSE 'false' END), 12) AS sig FROM messages),
        l AS (SELECT *, lag(sig) OVER w AS s0, lag(at_us) OVER w AS a0 FROM s WINDOW w AS (PARTITION BY unit ORDER BY at_us, event_id)) SELECT unit, event_id, sig FROM l WHERE s0 IS NULL OR s0 <> sig OR at_us - a0 >= {45 * HOUR}""",
    ),
    "spread_sample": Query(
        spread_sample, ("O6",),
        f"""WITH {M}, r AS (SELECT event_id, at_us, row_number() OVER (ORDER BY at_us DESC, event_id DESC) - 1 AS i, count(*) OVER () AS n FROM messages)
        SELECT event_id, at_us FROM r WHERE n <= 200 OR i < 70 OR (i - 70) IN (SELECT CAST(floor(g * CAST((SELECT max(n) - 70 FROM r) AS DOUBLE) / 130) AS BIGINT) FROM range(130) t(g))""",
    ),
    "scene_lines": Query(
        scene_lines, ("O7",),
        f"""WITH {M}, r AS (SELECT unit, event_id, k, row_number() OVER (PARTITION BY unit ORDER BY at_us, event_id) AS f, row_number() OVER (PARTITION BY unit ORDER BY at_us DESC, event_id DESC) AS l FROM messages),
        b AS (SELECT *, CASE WHEN f = 1 THEN 0 WHEN k >= 90 THEN 1 WHEN l = 1 THEN 2 ELSE 3 END AS band FROM r) SELECT unit, event_id, band FROM b QUALIFY row_number() OVER (PARTITION BY unit ORDER BY band, k DESC, event_id) <= 6""",
    ),
    "block_budget": Query(
        block_budget, ("O8",),
        """WITH c AS (SELECT conv_id, count(*) AS lines FROM conversations GROUP BY 1), b AS (SELECT *, coalesce(sum(lines) OVER (PARTITION BY conv_id // 40 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
        SELECT conv_id, lines, CAST(least(lines, greatest(2, 150 - used)) AS BIGINT) AS shown FROM b""",
    ),
    "list_merges": Query(
        list_merges, ("U1", "U2", "U5", "U7", "B3"),
        f"""WITH {M}, f AS (SELECT unit, at_us >= {NOW - 12 * DAY} AS late, call_type, min((at_us, event_id)) AS f FROM messages GROUP BY 1, 2, 3),
        u AS (SELECT unit, coalesce(list(call_type ORDER BY f, call_type) FILTER (NOT late), []) AS a, coalesce(list(call_type ORDER BY f, call_type) FILTER (late), []) AS b FROM f GROUP BY unit),
        m AS (SELECT *, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS un FROM u)
        SELECT unit, array_to_string(un, ',') AS merged, array_to_string(un[1:3], ',') AS capped, len(list_filter(a, lambda x: list_contains(b, x))) AS common, array_to_string(list_filter(un, lambda x: NOT list_contains(b, x)), ',') AS undone,
          len(a) = 0 OR len(b) = 0 OR list_has_any(a, b) AS compatible FROM m""",
    ),
    "word_matches": Query(
        word_matches, ("F2", "F3", "F5"),
        f"""WITH d AS (SELECT item_id, {_STEMMED} AS w FROM benchmark)
        SELECT item_id, concat_ws(',', {_said_sql()}) AS said, len(list_filter(w, lambda x: left(x, 1) = 't' AND abs(length(x) - 6) <= 1 AND levenshtein(x, 'thonin') = 1)) > 0 AS near FROM d""",
    ),
    "departments": Query(
        departments, ("F13",),
        r"""WITH d AS (SELECT n_nationkey, lower(translate(n_name, '_0123456789', ' abcdefghij')) || ['_fire', ' PD', ' EMS dispatch', '-police scanner', ''][n_nationkey % 5 + 1] AS raw FROM nation),
        s AS (SELECT n_nationkey, trim(regexp_replace(regexp_replace(lower(raw), '[_\-.]+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM d),
        t AS (SELECT n_nationkey, CASE WHEN regexp_matches(s, 'fire|\bfd\b') THEN 'Fire' WHEN regexp_matches(s, '\bems\b|ambulance') THEN 'EMS' WHEN regexp_matches(s, 'police|\bpd\b') THEN 'Police' END AS svc,
          trim(regexp_replace(regexp_replace(s, 'fire|police|ambulance|scanner|dispatch|\b(?:ems|fd|pd)\b', ' ', 'g'), '\s+', ' ', 'g')) AS town FROM s)
        SELECT n_nationkey, array_to_string(list_transform(string_split(town, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') || CASE WHEN svc IS NULL THEN '' ELSE ' ' || svc END AS dept FROM t""",
    ),
    "local_stamps": Query(
        local_stamps, ("F21", "P10"),
        f"""WITH {M} SELECT event_id, strftime({_LOCAL}, '%H:%M') AS clock, strftime({_LOCAL}, '%Y-%m-%d %H:%M:%S') AS stamp,
        try_cast('2023-' || lpad(CAST(event_id % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 32 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS exists FROM messages""",
    ),
    "alert_cells": Query(
        alert_cells, ("F24", "F25"),
        f"""WITH {CALLS_SQL}, w AS (SELECT *, list_filter(list_filter(string_split({_PLAIN}, ' '), lambda x: x <> ''), lambda x: x NOT IN ({_STOP}))[1:6] AS words FROM calls)
        SELECT lower(call_type) || '|' || CASE WHEN k >= 60 THEN printf('%.2f', lat) || ',' || printf('%.2f', lon) WHEN k >= 30 THEN replace(street, ' ', '-') ELSE 'nowhere|' || array_to_string(words, '-') END AS alert_key, count(*) AS n, min(at_us) AS first_us FROM w GROUP BY 1""",
    ),
    "scene_kinds": Query(
        scene_kinds, ("C14",),
        rf"""WITH {CALLS_SQL}, g AS (SELECT bool_or(regexp_matches(text, '\b(?:shots|stabbing|gun)\b')) AS crime, bool_or(regexp_matches(text, '\b(?:fire|alarm)\b')) AS fire, bool_or(regexp_matches(text, '\b(?:pursuit|fleeing)\b')) AS chase,
          bool_or(regexp_matches(text, '\bmedical\b')) AS medical, bool_or(regexp_matches(text, '\bcrash\b')) AS crash FROM calls GROUP BY street, at_us // {DAY})
        SELECT CASE WHEN crime THEN 'crime' WHEN fire THEN 'fire' WHEN chase THEN 'chase' WHEN medical THEN 'medical' WHEN crash THEN 'crash' ELSE 'other' END AS kind, count(*) AS scenes FROM g GROUP BY 1""",
    ),
    "call_log": Query(
        call_log, ("G10",),
        "WITH c AS (SELECT role, coalesce(length(text), 0) AS n, coalesce(length(text), 0) * 3 + turn AS ms FROM conversations) SELECT role, count(*) AS n, count(*) FILTER (c.n < 30) AS failed, round(avg(ms), 4) AS mean_ms, max(ms) AS most_ms FROM c GROUP BY role",
    ),
    "published_numbers": Query(
        published_numbers, ("G19", "G13"),
        f"""WITH {M}, a AS (SELECT count(*) AS n, count(DISTINCT feed) AS feeds, count(DISTINCT unit) AS units, count(*) FILTER (k >= 50) AS labelled, (max(at_us) - min(at_us)) / CAST({DAY} AS DOUBLE) AS days FROM messages),
        t AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM messages GROUP BY unit))
        SELECT unnest(['rows', 'feeds', 'units', 'labelled_pct', 'per_year', 'most_repeats']) AS name, unnest([CAST(n AS DOUBLE), feeds, units, round(labelled / CAST(n AS DOUBLE) * 100, 6), round(n / days * 365, 6), most]) AS value FROM a, t""",
    ),
    "cleaned_transcripts": Query(
        cleaned_transcripts, ("P2", "P3"),
        rf"""WITH {CALLS_SQL}, c AS (SELECT event_id, trim(regexp_replace('[static] ' || text, '\[[^\]]*\]|\([^)]*\)', ' ', 'g')) AS text FROM calls),
        w AS (SELECT event_id, text, len(list_distinct(list_filter({_TOKENS}, lambda w: length(w) >= 3))) AS n, regexp_matches(text, '\b[0-9]{{1,5}} [a-z]+ (?:street|road|avenue|lane|square)\b|traffic stop') AS fact FROM c)
        SELECT NOT (text IN ('test test test', 'thank you', 'copy') OR n <= 2) OR fact AS kept, fact, count(*) AS n, min(event_id) AS first_id FROM w GROUP BY 1, 2""",
    ),
    "startable": Query(
        startable, ("P6",),
        rf"""WITH {CALLS_SQL}, c AS (SELECT event_id, k, k >= 50 AS exact, regexp_matches(street, 'square$') AS venue, contains(text, 'traffic stop') AS stop, regexp_matches(text, '\b(?:respond|strike|report)\b') AS dispatch FROM calls)
        SELECT event_id, exact, venue, dispatch FROM c WHERE (exact OR venue) AND NOT stop AND (dispatch OR venue OR k >= 90)""",
    ),
    "feed_tags": Query(
        feed_tags, ("P8",),
        f"""WITH {M}, f AS (SELECT unit, feed AS tag, min((at_us, event_id)) AS f FROM messages WHERE feed IN (SELECT 'feed-' || n_nationkey FROM nation WHERE n_nationkey < 15) GROUP BY 1, 2),
        k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY unit ORDER BY f, tag) <= 6) SELECT unit, string_agg(tag, ',' ORDER BY f, tag) AS tags FROM k GROUP BY unit""",
    ),
    "loud_windows": Query(
        loud_windows, ("P14",),
        """WITH r AS (SELECT l_orderkey, (l_linenumber - 1) // 2 AS w, sqrt(avg((l_discount - CAST(0.05 AS DOUBLE)) * (l_discount - CAST(0.05 AS DOUBLE)))) AS rms FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, CAST(greatest(0, min(w) - 1) AS BIGINT) AS from_w, CAST(max(w) + 1 AS BIGINT) AS to_w FROM r WHERE round(rms, 9) >= 0.03 GROUP BY 1""",
    ),
    "rollup_names": Query(
        rollup_names, ("B20",), f"""WITH {M} SELECT event_id, strftime("at", '%Y-%m-%d') AS day, CAST(strftime("at", '%H') AS INTEGER) AS hour, at_us AS written FROM messages""",
    ),
}
