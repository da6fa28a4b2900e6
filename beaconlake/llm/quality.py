"""Quality rules: base counts of a text and cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, blanks collapsed) and hashed.  A line that
more than ``max(min_docs, share * texts of the host)`` distinct texts of one host hold is
boilerplate of that host and is removed; a document that loses more than ``max_lost`` of its
words is depleted and rejected.  Copies of one text count once, so duplication alone, which is
for other stages, makes no line boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm import kernels
from beaconlake.llm.scratch import Scratch, unused

MIN_DOCS = 10
SHARE = 0.002
MAX_LOST = 0.5

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NORMAL = kernels.LOWER_ASCII.copy()
_NORMAL[ord("0") : ord("9") + 1] = ord("0")
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_doc(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[borders[1:]] - total[borders[:-1]]


def _repeated(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their own document."""
    with np.errstate(over="ignore"):
        keyed = kernels.mix64(values + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keyed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(values), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keyed), len(twice) - 1)] == keyed


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every document, and its lines with a word: line_doc, line_no, line_hash, line_words."""
    n = len(offsets) - 1
    starts, ends, docs = kernels.words(buf, offsets)
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": np.bincount(docs, minlength=n), "word_chars": _per_doc(lead & ~kernels.BLANK[buf], offsets), "n_symbols": _per_doc(_SYMBOL[buf], offsets)}
    windows, at = kernels.window_hashes(kernels.span_hashes(buf, starts, ends), docs, 3)
    again = at[_repeated(windows, docs[at])]
    covered = np.zeros(len(starts) + 2, dtype=bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = np.bincount(docs[covered[: len(starts)]], minlength=n)
    feed = buf == 0x0A
    line_from, line_to = kernels.runs(~feed, offsets)
    first_word = np.searchsorted(starts, line_from)
    end_word = np.searchsorted(starts, line_to)
    worded = end_word > first_word
    line_from, line_to, first_word, end_word = line_from[worded], line_to[worded], first_word[worded], end_word[worded]
    line_doc = docs[first_word]
    raw = kernels.span_hashes(buf, line_from, line_to)
    order = np.lexsort((raw, line_doc))
    same = (raw[order][1:] == raw[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out["n_dup_lines"] = np.bincount(line_doc[order][1:][same], minlength=n)
    feeds = np.concatenate(([0], np.cumsum(feed)))
    out["line_doc"], out["line_words"] = line_doc, end_word - first_word
    out["line_no"] = feeds[line_from] - feeds[offsets[line_doc]]
    out["line_hash"] = kernels.sequence_hashes(kernels.span_hashes(_NORMAL[buf], starts, ends), first_word, end_word)
    return out


def measured(docs: DataFrame, *, key: str, host: str, text: str) -> DataFrame:
    """Per row of ``docs``: key, host, digest of the text, the counts and lines array<(no, words, hash)>."""
    few = docs.select(F.col(key), F.col(host), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), F.col(text))
    head = few.select(key, host, "digest").schema
    schema = head
    for name in _COUNTS:
        schema = schema.add(name, "long")
    lines_type = "array<struct<no:int,words:int,hash:bigint>>"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", lines {lines_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, buf, offsets in kernels.slices(batch.column(3)):
                m = measure(buf, offsets)
                borders = np.searchsorted(m["line_doc"], np.arange(count + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(m["line_no"].astype(np.int32)), pa.array(m["line_words"].astype(np.int32)), pa.array(m["line_hash"].view(np.int64))], names=["no", "words", "hash"])
                lines = pa.ListArray.from_arrays(pa.array(borders), values)
                own = [batch.column(i).slice(first, count) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(m[c].astype(np.int64)) for c in _COUNTS), lines], names=[*schema.names, "lines"])

    return few.mapInArrow(run, ddl)


def frequent_lines(stats: DataFrame, *, host: str, min_docs: int, share: float) -> DataFrame:
    """Boilerplate: (_host, _hash, n_docs) of the lines above the limit of their host.  A null host is one host."""
    held = stats.select(host, "digest", F.explode(F.array_distinct(F.col("lines.hash"))).alias("hash")).distinct()
    counts = held.groupBy(host, "hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    texts = stats.select(host, "digest").distinct().groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_texts"))
    over = counts.join(texts, F.col(host).eqNullSafe(F.col("_host"))).filter(F.col("n_docs") > share * F.col("_texts"))
    return over.select("_host", F.col("hash").alias("_hash"), "n_docs")


def judge(
    docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, share: float = SHARE, max_lost: float = MAX_LOST, label: str = "quality"
) -> DataFrame:
    """One row per row of ``docs``: key, host, digest, the counts, base_failed, lost_words, lost_lines, kept.

    ``lost_lines`` are the numbers (from 0, by ``\\n``) of the lines to remove.  Null texts have no
    words and fail the base rules.  Repeated rows get equal verdicts; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, label)
    stats = scratch.table(measured(docs, key=key, host=host, text=text), "stats")
    frequent = scratch.table(frequent_lines(stats, host=host, min_docs=min_docs, share=share), "frequent")
    each = stats.select(F.col(key).alias("_key"), F.col(host).alias("_h"), F.col("digest").alias("_digest"), F.explode("lines").alias("line"))
    hits = each.join(frequent, F.col("_h").eqNullSafe(F.col("_host")) & (F.col("line.hash") == F.col("_hash")))
    # Repeated rows bring each line number again; the set and the sum over distinct lines count it once.
    lost = hits.select("_key", "_h", "_digest", "line.no", "line.words").distinct()
    lost = lost.groupBy("_key", "_h", "_digest").agg(F.sum("words").alias("_lost"), F.array_sort(F.collect_list("no")).alias("_lines"))
    rows = stats.drop("lines").join(lost, F.col(key).eqNullSafe(F.col("_key")) & F.col(host).eqNullSafe(F.col("_h")) & (F.col("digest") == F.col("_digest")), "left")
    lost_words = F.coalesce("_lost", F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        key, host, "digest", *_COUNTS, failed.alias("base_failed"), lost_words.alias("lost_words"), F.coalesce("_lines", F.array().cast("array<int>")).alias("lost_lines"),
        (~failed & (lost_words <= max_lost * F.col("n_words"))).alias("kept"),
    )


def clean(docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents that pass, without their boilerplate lines; the columns of ``docs`` in order."""
    k, s, d, gone = unused(docs, "_k", "_s", "_d", "_gone")
    verdict = judge(docs, key=key, host=host, text=text, **options).filter("kept").groupBy(F.col(key).alias(k), F.col(host).alias(s), F.col("digest").alias(d)).agg(F.first("lost_lines").alias(gone))
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.join(verdict, F.col(key).eqNullSafe(F.col(k)) & F.col(host).eqNullSafe(F.col(s)) & (digest == F.col(d)))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    return rows.withColumn(text, F.when(F.size(gone) > 0, left).otherwise(F.col(text))).select(*docs.columns)


def op4_quality(docs: DataFrame) -> DataFrame:
    """Contract columns of :func:`judge`, which states nulls, repeats and empty tables, and lost_words."""
    return judge(docs).select("doc_id", *_COUNTS, "base_failed", "kept", "lost_words")
