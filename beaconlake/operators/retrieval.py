"""Lexical retrieval: scored questions, overlap joins, fuzzy names, gazetteer scans, grounding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import text as tx
from beaconlake.sources.shared import fresh_folder


@dataclass(frozen=True)
class Question:
    """A parsed question: what kind of thing, which words and phrases, and whether the big ones are wanted."""

    words: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = field(default_factory=tuple)
    kind: str | None = None
    big: bool = False

    @property
    def asked(self) -> int:
        return (self.kind is not None) + len(self.phrases) + len(self.words)


def score_documents(docs: DataFrame, q: Question) -> DataFrame:
    """(doc_id, score) of the documents that answer ``q``.

    Kind 10, phrase 8, word 3; a question that names something needs one named hit, a wrong kind
    rules out; long texts stand for big ones.  The score grows with the share of what was asked.
    """
    flat, words = tx.plain(F.col("text")), tx.tokens(F.col("text"))
    named = F.lit(0)
    score = F.lit(0)
    for phrase in q.phrases:
        said = F.exists(F.array(*map(F.lit, phrase)), lambda p: F.contains(F.col("_flat"), p)).cast("int")
        named, score = named + said, score + 8 * said
    for word in q.words:
        said = F.array_contains(F.col("_words"), word).cast("int")
        named, score = named + said, score + 3 * said
    rows = docs.withColumn("_flat", flat).withColumn("_words", words)
    hits = named
    if q.kind is not None:
        rows = rows.filter(F.col("lang") == q.kind)
        score, hits = score + 10, hits + 1
    if q.big:
        score = score + F.when(F.col("n_chars") >= 5000, 3).otherwise(0)
    rows = rows.filter(named > 0) if q.words or q.phrases else rows
    return rows.select("doc_id", F.round(score * (1 + hits / F.lit(float(max(q.asked, 1)))), 6).alias("score"))


def overlap_join(items: DataFrame, docs: DataFrame, item: str, doc: str, least: int, share: float, k: int) -> DataFrame:
    """Pairs whose common words are at least ``share`` of max(``least``, item words); the best ``k`` of each item.

    Words are distinct in each list.  A document that has ``need`` of an item's n words has one of its
    n - need + 1 rarest, so only those are keys: what every document says brings nobody together.
    """
    need = F.ceil(F.greatest(F.lit(least), F.size("words")) * share - 1e-9).cast("int")
    asked = items.select(item, F.size("words").alias("_n"), need.alias("_need"), F.explode("words").alias("_v"))
    spark, where = docs.sparkSession, fresh_folder(docs.sparkSession, "overlap")
    asked.select(F.col("_v").alias("_s")).distinct().withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{where}/words")  # numbered once, when written
    said = spark.read.parquet(f"{where}/words")
    # Of a document only the words that some item has, as numbers; texts are read and cut once, and go into no join.
    docs.select(F.col(doc).alias("_doc"), F.explode("words").alias("_w")).join(said, F.col("_w") == F.col("_s")).select("_doc", "_id").write.parquet(f"{where}/postings")
    held = spark.read.parquet(f"{where}/postings")
    common = held.groupBy(F.col("_id").alias("_c")).agg(F.count("*").alias("_df"))
    numbered = asked.join(said, F.col("_v") == F.col("_s")).drop("_s")
    placed = numbered.join(common, F.col("_id") == F.col("_c"), "left").withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(F.coalesce("_df", F.lit(0)), "_v")))
    keys = placed.filter("_df IS NOT NULL AND _need <= _n AND _r <= _n - _need + 1").select(item, F.col("_id").alias("_k"))
    near = keys.join(held, F.col("_k") == F.col("_id")).select(F.col(item).alias("_item"), F.col("_doc").alias("_near")).distinct()
    of_docs = held.groupBy("_doc").agg(F.collect_list("_id").alias("_b"))
    of_items = numbered.groupBy(item).agg(F.collect_list("_id").alias("_a"), F.first("_n").alias("_n"))
    both = near.join(of_docs, F.col("_near") == F.col("_doc")).join(of_items, F.col("_item") == F.col(item))
    # Computed inside a generator, so that the filter below doesn't compute it again.
    hits = both.select(item, F.col("_doc").alias(doc), "_n", F.explode(F.array(F.size(F.array_intersect("_a", "_b")).cast("bigint"))).alias("hits"))
    part = F.col("hits") / F.greatest(F.lit(least), F.col("_n"))
    best = hits.filter(part >= share).withColumn("share", F.round(part, 6)).withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("hits"), doc)))
    return best.filter(F.col("_r") <= k).select(item, doc, "hits", "share")


def trace(items: DataFrame, lines: DataFrame, item: str, line: list[str], k: int) -> DataFrame:
    """Lines that prose cites: numbers weigh 5 and words of three letters 1; score 5 or three words are needed."""
    i = items.select(item, F.explode(F.array_distinct("words")).alias("_w"))
    l = lines.select(*line, F.explode(F.array_distinct("words")).alias("_w"))
    digits = F.col("_w").rlike("^[0-9]+$")
    hits = i.join(l, "_w").filter((F.length("_w") >= 3) | digits).groupBy(item, *line)
    scored = hits.agg(F.sum(F.when(digits, 5).otherwise(1)).alias("score"), F.count_if(~digits).alias("words")).filter("score >= 5 OR words >= 3")
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), *line))).filter(F.col("_r") <= k).drop("_r")


#: What a clock, a number and a word are worth, and what a line must reach.
CLOCK, NUMBER, WORD, LEAST, LEAST_WORDS, MOST_LINES = 8, 5, 1, 5, 3, 12


def evidence(text: Column) -> Column:
    """Numbers of two digits or more and words of four letters or more in a text, the clocks in it left out."""
    rest = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<![0-9a-z])[0-9]{1,2}:[0-9]{2}\s*(?:[ap]\.?m\.?)?", " ")
    return F.array_distinct(F.filter(F.split(rest, "[^a-z0-9]+"), lambda w: w.rlike("^[0-9]{2,}$") | (~w.rlike("^[0-9]*$") & (F.length(w) > 3))))


def citations(prose: DataFrame, lines: DataFrame) -> DataFrame:
    """What each piece of prose rests on: item, n, cited (ids of lines in order of time), first_at, last_at, score (of all).

    ``prose``: item, scope, text; ``lines``: line, scope, at, minute (of the local day), text; items and lines are keys.  Only lines
    of the same scope are looked at.  A line gains CLOCK if the prose names its minute, NUMBER for each number and WORD for each
    word they share; LEAST points or LEAST_WORDS words make it a citation, the MOST_LINES best stay.

    Texts with the same evidence score alike, so sets of evidence are compared and not lines: of each set a scope's first lines are
    enough, of each set of prose in a scope the best of those, and besides these only the lines of a minute that a clock names.
    """
    spark, where = lines.sparkSession, fresh_folder(lines.sparkSession, "citations")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    def first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= MOST_LINES).drop("_r")

    key = F.concat_ws(" ", F.array_sort(evidence(F.col("text")))).alias("_key")
    told = written(prose.select("item", "scope", key, F.array_distinct(tx.clock_minutes(F.col("text"))).alias("_clocks")), "told")
    said = written(lines.select("line", "scope", "at", "minute", key), "said")
    sets = written(told.select("_key").union(said.select("_key")).distinct().withColumn("_id", F.monotonically_increasing_id()), "sets")  # numbered once, when written
    told = written(told.join(sets, "_key").select("item", "scope", "_clocks", F.col("_id").alias("_a")), "items")
    said = said.join(sets, "_key").select("line", "scope", "at", "minute", F.col("_id").alias("_b"))
    said = written(first(said, ["scope", "_b", "minute"], "at", "line"), "lines")
    early = written(first(said, ["scope", "_b"], "at", "line"), "early")
    asking, heard = told.select("scope", "_a").distinct(), early.select("scope", "_b").distinct()

    # Pairs of sets that share a word, of all scopes together or in each, whichever are fewer.
    worded = sets.select("_id", F.explode(F.filter(F.split("_key", " "), lambda w: w != "")).alias("_w"))
    by_word = lambda df, c: df.join(worded, F.col(c) == F.col("_id")).drop("_id")
    sides = by_word(asking, "_a"), by_word(heard, "_b")
    plain = tuple(side.drop("scope").distinct() for side in sides)

    def met(pair: tuple[DataFrame, DataFrame], on: list[str]) -> int:
        n = [side.groupBy(*on).agg(F.count("*").cast("double").alias(f"_n{i}")) for i, side in enumerate(pair)]
        return n[0].join(n[1], on).agg(F.sum(F.col("_n0") * F.col("_n1"))).first()[0] or 0

    scoped = met(sides, ["scope", "_w"]) < met(plain, ["_w"])
    at_home = ["scope"] if scoped else []
    worth = F.when(F.col("_w").rlike("^[0-9]+$"), NUMBER).otherwise(WORD)
    left, right = sides if scoped else plain
    pairs = left.join(right, [*at_home, "_w"]).groupBy(*at_home, "_a", "_b").agg(F.sum(worth).alias("_points"), F.count_if(worth == WORD).alias("_words"))
    pairs = written(pairs, "pairs")

    strong = pairs.filter((F.col("_points") >= LEAST) | (F.col("_words") >= LEAST_WORDS)).drop("_words")
    order = F.desc("_points"), "at", "line"
    opening = early.withColumn("_o", F.row_number().over(Window.partitionBy("scope", "_b").orderBy("at", "line"))).filter("_o = 1").select("scope", "_b", "at", "line")
    among = opening.join(strong, [*at_home, "_b"]).join(asking, ["scope", "_a"], "left_semi")
    # A set's place among the sets is that of its first line.
    best = first(among, ["scope", "_a"], *order).select("scope", "_a", "_b", "_points")
    best = first(best.join(early, ["scope", "_b"]), ["scope", "_a"], *order)
    by_text = told.join(best, ["scope", "_a"]).select("item", "line", "at", (F.col("_points") + F.when(F.array_contains("_clocks", F.col("minute")), CLOCK).otherwise(0)).alias("score"))
    named = told.select("item", "scope", "_a", F.explode("_clocks").alias("minute")).join(said, ["scope", "minute"])
    by_clock = named.join(pairs, [*at_home, "_a", "_b"], "left").select("item", "line", "at", (F.lit(CLOCK) + F.coalesce("_points", F.lit(0))).alias("score"))
    cites = first(by_text.unionByName(by_clock).distinct(), ["item"], F.desc("score"), "at", "line")
    cited = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return cites.groupBy("item").agg(F.count("*").alias("n"), cited.alias("cited"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("score").alias("score"))


def fuzzy_candidates(heard: DataFrame, names: DataFrame, cap: int, k: int) -> DataFrame:
    """Names within ``cap`` edits of a heard word, blocked by first letter and length; the best ``k``.

    A candidate is confident if it is exact or the only one.
    """
    length = F.length("name")
    blocked = names.select("name", F.substring("name", 1, 1).alias("_f"), F.explode(F.sequence(length - cap, length + cap)).alias("_l"))
    asked = heard.select("heard", F.substring("heard", 1, 1).alias("_hf"), F.length("heard").alias("_hl"))
    met = asked.join(blocked, (F.col("_hf") == F.col("_f")) & (F.col("_hl") == F.col("_l"))).withColumn("edits", F.levenshtein("heard", "name", cap)).filter("edits >= 0")
    w = Window.partitionBy("heard")
    ranked = met.withColumn("place", F.row_number().over(w.orderBy("edits", "name"))).withColumn("confident", (F.count("*").over(w) == 1) | (F.col("edits") == 0))
    return ranked.filter(F.col("place") <= k).select("heard", "name", "edits", "place", "confident")


def ngram_scan(texts: DataFrame, gazetteer: DataFrame, longest: int) -> DataFrame:
    """The longest, then first, n-gram of each text that the gazetteer knows: id, name, words, position."""
    words = F.split(F.lower("text"), " ")
    grams = texts.select("id", words.alias("_w"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("words")).filter(F.col("words") <= F.size("_w"))
    grams = grams.select("id", "words", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("words") + 1)).alias("position"))
    grams = grams.select("id", "words", "position", F.array_join(F.slice("_w", F.col("position"), F.col("words")), " ").alias("name"))
    known = grams.join(gazetteer.select(F.lower("name").alias("name")).distinct(), "name")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("words"), "position"))
    return known.withColumn("_r", first).filter("_r = 1").select("id", "name", "words", "position")


def grounded(docs: DataFrame, claims: list[tuple[str, str, str]]) -> DataFrame:
    """Claims a text makes and whether it holds their evidence: doc_id, claim, grounded."""
    text = F.col("text")
    made: list[Column] = [F.when(text.rlike(tx.bounded(says)), F.struct(F.lit(name).alias("claim"), text.rlike(tx.bounded(evidence)).alias("grounded"))) for name, says, evidence in claims]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*made))).alias("c")).select("doc_id", "c.claim", "c.grounded")
