"""Queries of the text operators over documents, conversations, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.functions import text as tx
from beaconlake.operators import retrieval
from beaconlake.plans.core import Query
from beaconlake.sources.tables import table

#: A small lexicon over the invented languages of the tables.
LEXICON = [tx.Rule("alpha", "the|der", 1, True), tx.Rule("beta", "thand|schund", 3), tx.Rule("gamma", "onth|quever", 2), tx.Rule("delta", "and|und", 1), tx.Rule("epsilon", "edth|tion", 2, True)]
NEGATION, HEDGE = "not|of|de", "in|is|en"
KINDS = [("night", "thand|anth"), ("water", "onth|re"), ("road", "the|le"), ("sky", "und|and")]
STOCK = ["the the", "anble anes", "dieu der"]

_PLAIN = "trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_PLAIN}, ' '), lambda w: w <> '')"


def _signal_sql(rule: tx.Rule) -> str:
    """Text before the first match, cut to the look-back; the border characters are consumed by RE2's \\b."""
    cut = f"length(regexp_extract(text, '^((?s:.)*?)\\b(?:{rule.pattern})\\b', 1))"
    before = f"substr(text, greatest({cut} + 1 - {tx.LOOK_BACK}, 1), least({cut}, {tx.LOOK_BACK}))"
    hit = f"regexp_matches(text, '\\b(?:{rule.pattern})\\b') AND NOT regexp_matches({before}, '\\b(?:{NEGATION})\\b')"
    return f"CASE WHEN {hit} THEN {rule.tier} END AS {rule.id}, CASE WHEN {hit} THEN regexp_matches({before}, '\\b(?:{HEDGE})\\b') END AS {rule.id}_h"


def _ascii_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with accents blanked, so that both engines see the same word borders."""
    return table(spark, sf, "documents").select("doc_id", F.lower(F.regexp_replace("text", "[^\\x00-\\x7F]", " ")).alias("text"))


_ASCII = "ascii_docs AS (SELECT doc_id, lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')) AS text FROM documents)"


def lexicon_signals(spark: SparkSession, sf: str) -> DataFrame:
    d = _ascii_docs(spark, sf).withColumn("found", tx.signals(F.col("text"), LEXICON, NEGATION, HEDGE))
    return d.select("doc_id", F.array_join(F.transform("found", lambda s: s.id), ",").alias("ids"), F.coalesce(F.array_max(F.transform("found", lambda s: s.tier)), F.lit(0)).alias("top_tier"), F.size(F.filter("found", lambda s: s.hedged)).alias("hedged"))


def category(spark: SparkSession, sf: str) -> DataFrame:
    d = _ascii_docs(spark, sf)
    kind = F.when(F.length("text") < 13, "short").when(F.col("text").rlike("^[0-9 .]+$"), "readback").otherwise(F.coalesce(tx.first_match(F.col("text"), KINDS), F.when(F.length("text") < 70, "chatter").otherwise("other")))
    return d.select("doc_id", kind.alias("kind"))


def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.groupBy("role", tx.is_noise(F.col("text"), STOCK).alias("noise")).agg(F.count("*").alias("n"))


def fuzzy_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Heard words of conversations against the distinct words of benchmark items, one edit apart at most, by margin."""
    heard = table(spark, sf, "conversations").select(F.explode(tx.tokens(F.col("text"))).alias("heard")).filter("length(heard) >= 6").distinct()
    names = table(spark, sf, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("name")).filter("length(name) >= 6").distinct()
    return retrieval.fuzzy_candidates(heard, names, cap=1, k=3)


def ngram_scan(spark: SparkSession, sf: str) -> DataFrame:
    gazetteer = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("text"))
    return retrieval.ngram_scan(parts, gazetteer, longest=3)


def retrieval_score(spark: SparkSession, sf: str) -> DataFrame:
    q = retrieval.Question(words=("thonin", "tion", "reth"), phrases=(("of the", "in the"),), kind="en", big=True)
    return retrieval.score_documents(table(spark, sf, "documents"), q)


def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose words cover at least 34% of a benchmark item's distinct words, the best four each."""
    items = table(spark, sf, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("words"))
    docs = table(spark, sf, "documents").select("doc_id", F.array_distinct(tx.tokens(F.col("text"))).alias("words"))
    return retrieval.overlap_join(items, docs, "item_id", "doc_id", least=6, share=0.34, k=4)


def prose_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Rows cited by prose: numbers weigh 5, words 1."""
    items = table(spark, sf, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("words"))
    lines = table(spark, sf, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("words"))
    return retrieval.trace(items, lines, "item_id", ["conv_id", "turn"], k=12)


def masked_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Phone-shaped and long numbers of documents: how many, a hash to link by, and the masked text's length."""
    d = table(spark, sf, "documents").withColumn("found", F.regexp_extract_all("text", F.lit("[0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}"), F.lit(0)))
    hashed = F.array_join(F.array_sort(F.transform("found", lambda v: F.substring(F.sha2(F.regexp_replace(v, "[^0-9]", ""), 256), 1, 12))), ",")
    return d.select("doc_id", F.size("found").alias("n_found"), hashed.alias("keys"), F.char_length(tx.masked(F.col("text"), "[0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}", "number")).alias("masked_chars"))


QUERIES: dict[str, Query] = {
    "noise_filter": Query(
        noise_filter, ("P1",),
        f"""WITH c AS (SELECT role, {_PLAIN} AS flat, {_TOKENS} AS w FROM conversations)
        SELECT role, length(flat) < 6 OR flat IN ('the the', 'anble anes', 'dieu der') OR (len(w) < 3 AND NOT regexp_matches(flat, '[0-9]')) OR len(list_distinct(w)) = 1 AS noise, count(*) AS n FROM c GROUP BY 1, 2""",
    ),
    "lexicon_signals": Query(
        lexicon_signals, (),
        f"""WITH {_ASCII}, s AS (SELECT doc_id, {', '.join(_signal_sql(r) for r in LEXICON)} FROM ascii_docs)
        SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {r.id} IS NOT NULL THEN '{r.id}' END" for r in LEXICON)}) AS ids,
               coalesce(greatest({', '.join(r.id for r in LEXICON)}), 0) AS top_tier, {' + '.join(f"CASE WHEN {r.id}_h THEN 1 ELSE 0 END" for r in LEXICON)} AS hedged FROM s""",
    ),
    "category": Query(
        category, ("F26",),
        f"""WITH {_ASCII} SELECT doc_id, CASE WHEN length(text) < 13 THEN 'short' WHEN regexp_matches(text, '^[0-9 .]+$') THEN 'readback'
        {' '.join(f"WHEN regexp_matches(text, '\\b(?:{p})\\b') THEN '{k}'" for k, p in KINDS)} WHEN length(text) < 70 THEN 'chatter' ELSE 'other' END AS kind FROM ascii_docs""",
    ),
    "token_stems": Query(
        lambda s, d: table(s, d, "documents").select(F.explode(tx.with_stems(tx.tokens(F.col("text")))).alias("w"), "doc_id").groupBy("w").agg(F.count("*").alias("docs")).filter("docs >= 5"), ("F1",),
        f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents), s AS (SELECT doc_id, w FROM t
          UNION SELECT doc_id, left(w, length(w) - 1) FROM t WHERE length(w) > 3 AND w LIKE '%s' UNION SELECT doc_id, left(w, length(w) - 2) FROM t WHERE length(w) > 4 AND w LIKE '%es'
          UNION SELECT doc_id, left(w, length(w) - 3) FROM t WHERE length(w) > 5 AND w LIKE '%ing')
        SELECT w, count(DISTINCT doc_id) AS docs FROM s GROUP BY w HAVING count(DISTINCT doc_id) >= 5""",
    ),
    "fuzzy_candidates": Query(
        fuzzy_candidates, ("F3", "F4"),
        f"""WITH h AS (SELECT DISTINCT w AS heard FROM (SELECT unnest({_TOKENS}) AS w FROM conversations) WHERE length(w) >= 6),
        n AS (SELECT DISTINCT w AS name FROM (SELECT unnest({_TOKENS}) AS w FROM benchmark) WHERE length(w) >= 6),
        j AS (SELECT heard, name, levenshtein(heard, name) AS edits FROM h JOIN n ON left(heard, 1) = left(name, 1) AND abs(length(heard) - length(name)) <= 1 WHERE levenshtein(heard, name) <= 1)
        SELECT heard, name, edits, row_number() OVER (PARTITION BY heard ORDER BY edits, name) AS place, count(*) OVER (PARTITION BY heard) = 1 OR (edits = 0) AS confident FROM j QUALIFY place <= 3""",
    ),
    "ngram_scan": Query(
        ngram_scan, ("B6",),
        """WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' ') AS w FROM part),
        g AS (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM t, range(1, 4) a(n), range(1, 20) b(i) WHERE i + n - 1 <= len(w)),
        names AS (SELECT DISTINCT lower(p_name) AS name FROM part)
        SELECT id, gram AS name, n AS words, i AS position FROM g JOIN names ON gram = name QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, i) = 1""",
    ),
    "retrieval_score": Query(
        retrieval_score, (),
        f"""WITH d AS (SELECT doc_id, lang, n_chars, {_PLAIN} AS flat, {_TOKENS} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 10 ELSE 0 END AS kind_s, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS kind_h,
              CASE WHEN contains(flat, 'of the') OR contains(flat, 'in the') THEN 1 ELSE 0 END AS ph,
              {' + '.join(f"CASE WHEN list_contains(w, '{x}') THEN 1 ELSE 0 END" for x in ('thonin', 'tion', 'reth'))} AS wh, CASE WHEN n_chars >= 5000 THEN 3 ELSE 0 END AS big FROM d)
        SELECT doc_id, round((kind_s + 8 * ph + 3 * wh + big) * (1 + (kind_h + ph + wh) / CAST(5 AS DOUBLE)), 6) AS score FROM s WHERE kind_h = 1 AND ph + wh > 0""",
    ),
    "token_overlap": Query(
        token_overlap, ("J12",),
        f"""WITH i AS (SELECT item_id, list_distinct({_TOKENS}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({_TOKENS}) AS w FROM documents),
        iw AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM i), dw AS (SELECT doc_id, unnest(w) AS t FROM d),
        j AS (SELECT item_id, doc_id, count(*) AS hits, any_value(n) AS n FROM iw JOIN dw USING (t) GROUP BY 1, 2)
        SELECT item_id, doc_id, hits, round(hits / CAST(greatest(6, n) AS DOUBLE), 6) AS share FROM j WHERE hits / CAST(greatest(6, n) AS DOUBLE) >= 0.34
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) <= 4""",
    ),
    "prose_trace": Query(
        prose_trace, ("J11", "B14"),
        f"""WITH i AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS t FROM benchmark), l AS (SELECT DISTINCT conv_id, turn, unnest({_TOKENS}) AS t FROM conversations),
        j AS (SELECT item_id, conv_id, turn, CAST(sum(CASE WHEN regexp_matches(t, '^[0-9]+$') THEN 5 ELSE 1 END) AS BIGINT) AS score, count(*) FILTER (NOT regexp_matches(t, '^[0-9]+$')) AS words
              FROM i JOIN l USING (t) WHERE length(t) >= 3 OR regexp_matches(t, '^[0-9]+$') GROUP BY 1, 2, 3)
        SELECT * FROM j WHERE score >= 5 OR words >= 3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn) <= 12""",
    ),
    "claim_grounding": Query(
        lambda s, d: retrieval.grounded(_ascii_docs(s, d), [("fire", "thand", "the|and"), ("crash", "onth", "tion|of"), ("chase", "und", "der")]), ("C10",),
        f"""WITH {_ASCII}, c(claim, says, evidence) AS (VALUES ('fire', 'thand', 'the|and'), ('crash', 'onth', 'tion|of'), ('chase', 'und', 'der'))
        SELECT doc_id, claim, regexp_matches(text, '\\b(?:' || evidence || ')\\b') AS grounded FROM ascii_docs, c WHERE regexp_matches(text, '\\b(?:' || says || ')\\b')""",
    ),
    "masked_ids": Query(
        masked_ids, (),
        """WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}') AS f FROM documents)
        SELECT doc_id, len(f) AS n_found, array_to_string(list_sort(list_transform(f, lambda v: left(sha256(regexp_replace(v, '[^0-9]', '', 'g')), 12))), ',') AS keys,
        length(regexp_replace(text, '[0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}', '[number]', 'g')) AS masked_chars FROM d""",
    ),
    "address_keys": Query(
        lambda s, d: table(s, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), tx.slug(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)).alias("slug"), F.parse_url("url", F.lit("HOST")).rlike("(^|\\.)example\\.(com|net)$").alias("allowed")), ("F23", "P13"),
        """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, left(replace(trim(regexp_replace(lower(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 48) AS slug,
        regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\\.)example\\.(com|net)$') AS allowed FROM pages""",
    ),
    "alert_keys": Query(
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat_ws("|", F.lower("o_orderpriority"), F.format_string("%.2f", F.col("o_totalprice") / 1000), F.substring(F.sha1(F.col("o_custkey").cast("string")), 1, 10)).alias("alert_key")).groupBy("alert_key").agg(F.count("*").alias("n")).filter("n > 0").select(F.substring("alert_key", -10, 10).alias("who"), "n").groupBy("who").agg(F.sum("n").alias("n")), ("F25",),
        "SELECT left(sha1(CAST(o_custkey AS VARCHAR)), 10) AS who, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    ),
    "place_words": Query(
        lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_except(F.filter(tx.tokens(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")), F.array(*map(F.lit, ("the", "and", "was"))))), " ").alias("words")), ("F10",),
        f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('the', 'and', 'was')))), ' ') AS words FROM benchmark",
    ),
    "normal_fields": Query(
        lambda s, d: table(s, d, "conversations").filter(F.length(F.trim("text")) >= 4).select("conv_id", "turn", F.substring("text", 1, 400).alias("text"), F.coalesce(tx.cleaned_value(F.col("role")), F.lit("unknown")).alias("role"), tx.number(F.concat(F.col("turn").cast("string"), F.lit(",000"))).alias("seq")), ("S2", "P11", "P12", "B30", "F33"),
        "SELECT conv_id, turn, substr(text, 1, 400) AS text, coalesce(CASE WHEN lower(trim(role)) IN ('', 'none', 'null', 'unknown', 'n/a', 'undefined') THEN NULL ELSE trim(role) END, 'unknown') AS role, CAST(turn * 1000 AS DOUBLE) AS seq FROM conversations WHERE length(trim(text)) >= 4",
    ),
}
