"""Substring dedup by hashing units of text: lines, paragraphs or sentences.

A unit's words, in ASCII lower case and joined without their blanks, are hashed to 128 bits; the
digests meet in one global grouping.  Of units with one digest the occurrence with the smallest
(key, start) stays and the rest go, each known by its offsets in the original text.

Several units can be taken together (:func:`repeated_passages`).  They are nested, and whatever
goes has an earlier occurrence, so that every sequence of words that is removed stays somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm import kernels
from beaconlake.llm.scratch import Scratch, unused

#: A sentence of fewer words goes only as part of a line or paragraph.
MIN_WORDS = 8
#: Units taken together, with the fewest words of each.
PASSES = (("line", 1), ("paragraph", 1), ("sentence", MIN_WORDS))
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def unit_spans(buf: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the units.  Lines end at ``\\n``, paragraphs at two of them, sentences at a line
    end or at a blank after ``.``, ``!`` or ``?``."""
    feed = buf == 0x0A
    before = np.concatenate(([False], feed[:-1])) if len(buf) else feed
    after = np.concatenate((feed[1:], [False])) if len(buf) else feed
    if unit == "line":
        edge = feed
    elif unit == "paragraph":
        edge = feed & (before | after)
    elif unit == "sentence":
        stop = _STOP[buf]
        edge = feed | (kernels.BLANK[buf] & np.concatenate(([False], stop[:-1]))) if len(buf) else feed
    else:
        raise ValueError(f"unit must be line, paragraph or sentence, not {unit!r}")
    return kernels.runs(~edge, offsets)


def units(docs: DataFrame, *, key: str, text: str, passes: Sequence[tuple[str, int]]) -> DataFrame:
    """Rows (key, start, end, words, h1, h2) of the units of each (unit, fewest words) of ``passes``; offsets in characters.

    A span that is several kinds of unit gives one row.
    """
    few = docs.select(key, text)
    kind = few.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, buf, offsets in kernels.slices(batch.column(1)):
                starts, ends, docs_of = kernels.words(buf, offsets)
                spans = []
                for unit, least in passes:
                    a, b = unit_spans(buf, offsets, unit)
                    first, end = np.searchsorted(starts, a), np.searchsorted(starts, b)
                    many = end - first >= least
                    spans.append(first[many] * (len(starts) + 1) + end[many])
                first, end = np.divmod(np.unique(np.concatenate(spans)), len(starts) + 1)
                lower = kernels.LOWER_ASCII[buf]
                digests = [kernels.sequence_hashes(kernels.span_hashes(lower, starts, ends, lane), first, end, lane) for lane in (0, 1)]
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                doc = docs_of[first]
                base = chars[offsets[doc]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + row)),
                        pa.array((chars[starts[first]] - base).astype(np.int64)),
                        pa.array((chars[ends[end - 1]] - base).astype(np.int64)),
                        pa.array((end - first).astype(np.int32)),
                        *(pa.array(d.view(np.int64)) for d in digests),
                    ],
                    names=["key", "start", "end", "words", "h1", "h2"],
                )

    return few.mapInArrow(run, f"key {kind}, start bigint, end bigint, words int, h1 bigint, h2 bigint")


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS, label: str = "substring") -> DataFrame:
    """Every span to remove: key, start, end, words, kept_key, kept_start (the occurrence that stays).

    Offsets count characters of the original text.  Null and empty texts have no units.  Rows that
    repeat a key count as one document: equal units at equal places are one occurrence, and ties
    otherwise go to the smaller start; a null key ranks first.  An empty table gives no rows.
    """
    return _repeated(docs, key, text, [(unit, min_words)], label)


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", passes: Sequence[tuple[str, int]] = PASSES, label: str = "substring") -> DataFrame:
    """The spans to remove under several units together, with the columns of :func:`repeated_spans`.

    Units of any kind with the same words are occurrences of one passage.  A span inside another one
    of its document that goes too is left out, so that no text is counted twice; a span that several
    rows of one key give is one row.
    """
    found = _repeated(docs, key, text, passes, label)
    (past,) = unused(found, "_past")
    earlier = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn(past, F.max("end").over(earlier)).filter(F.col(past).isNull() | (F.col("end") > F.col(past)))
    return outer.drop(past)


def _repeated(docs: DataFrame, key: str, text: str, passes: Sequence[tuple[str, int]], label: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, label)
    rows = scratch.table(units(docs, key=key, text=text, passes=passes), "units")
    place = F.struct("key", "start")
    groups = rows.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    groups = scratch.table(groups.filter(~F.col("_first").eqNullSafe(F.col("_last"))), "repeated")
    hits = rows.join(groups, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    gone = hits.filter(~place.eqNullSafe(F.col("_first")))
    return gone.select(F.col("key").alias(key), "start", "end", "words", F.col("_first.key").alias("kept_key"), F.col("_first.start").alias("kept_start"))


def remove_spans(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the spans (key, start, end) in their texts; the columns of ``docs`` in order.

    Spans are gathered per document, as many as it has units; none may lie inside another.  Rows that repeat a key all lose them.
    """
    k, gone = unused(docs, "_k", "_cuts")
    cuts = spans.groupBy(F.col(key).alias(k)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(gone))
    joined = docs.join(cuts, F.col(key).eqNullSafe(F.col(k)), "left")
    at = F.concat(F.array(F.lit(0).cast("bigint")), F.col(f"{gone}.end"))
    upto = F.concat(F.col(f"{gone}.start"), F.array(F.char_length(text).cast("bigint")))
    parts = F.zip_with(at, upto, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    return joined.withColumn(text, F.when(F.size(gone) > 0, F.array_join(parts, "")).otherwise(F.col(text))).select(*docs.columns)


def _named(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "words", F.col("kept_key").alias("kept_doc_id"), F.col("kept_start").alias("kept_start_char"))


def op5_substring(docs: DataFrame) -> DataFrame:
    """Repeated sentences alone; the registered query is :func:`op5_passages`."""
    return _named(repeated_spans(docs))


def op5_passages(docs: DataFrame) -> DataFrame:
    """Repeated lines and paragraphs of any length, and sentences of MIN_WORDS words or more."""
    return _named(repeated_passages(docs))
