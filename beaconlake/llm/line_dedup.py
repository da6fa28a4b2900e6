"""Fuzzy line dedup by MinHash.

A line's set holds the hashes of its k-character shingles (ASCII lower case, blanks at the ends
dropped; a line shorter than k is one shingle).  Equal lines, by a 128-bit digest, form a class,
whose number is the first half of that digest; where lines differ in the second half only, both halves make it.
One permutation hash per shingle, split over bins, gives a signature; a bin without a shingle
takes the value of another one, drawn anew for every bin, so that the bins of a short line stay as
independent as those of a long one.  BANDS bands of ROWS bins are the keys of candidate lists,
which go through the shuffle as blocks, are verified by exact Jaccard and joined by components
(:mod:`.setjoin`).  One line of a component, the first by (key, line number), stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm import kernels
from beaconlake.llm.scratch import Scratch, unused
from beaconlake.llm.setjoin import SHORT_LIST, JaccardComponents

WIDTH = 5
ROWS = 6
BANDS = 20
BINS = ROWS * BANDS
#: Lines that are signed at once; few, so that their arrays stay in a core's cache.
CHUNK = 1 << 7
#: Band keys that a task holds before it gives them on, ranges of keys per shuffle partition, and the keys that a range is made for.
KEYS_AT_ONCE = 1 << 18
PARTS = 8
KEYS_PER_PART = 1 << 20
#: Bits for a hash in the table of what is wanted, and the most bits of that table; a full one only lets more lines through to the join.
FLAG_BITS, MOST_FLAGS = 16, 1 << 27
#: Blanks at an end of a line that are taken off one by one before all blanks are looked up at once.
TRIMS = 16
_CHAR = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
_PLACE = np.random.default_rng(20240302).integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.zeros(0, np.int64)
#: Bin from which an empty bin takes its value at each try.
_PROBES = np.random.default_rng(20240301).integers(0, BINS, (64, BINS))


def _shingles(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the span, hash) of every shingle of spans of lower-case text, repeats included; spans are in order, apart and not empty.

    A shingle is the sum of its characters, each (up to four bytes as one number) times a random odd
    number of its place, mixed; a span of fewer characters is one shingle.
    """
    if len(buf) and buf.max() < 0x80:
        first, stop, n = start, end, len(buf)
        chars = np.zeros(n + WIDTH, np.uint64)
        chars[:n] = buf
    else:
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        first, stop, n = np.searchsorted(lead, start), np.searchsorted(lead, end), len(lead)
        sizes = np.diff(np.append(lead, len(buf)))
        padded = np.concatenate((buf, np.zeros(4, np.uint8)))
        chars = np.ndarray(len(buf) + 1, "<u4", padded, 0, (1,))[lead] & _CHAR[sizes]
        chars = np.concatenate((chars, np.zeros(WIDTH, np.uint32))).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = chars[:n] * _PLACE[0]
        part = np.empty_like(total)
        for k in range(1, WIDTH):
            total += np.multiply(chars[k : n + k], _PLACE[k], out=part)
    count = np.maximum(1, stop - first - WIDTH + 1)
    short = np.flatnonzero(stop - first < WIDTH)
    if len(short):
        total[first[short]] = kernels.span_hashes(buf, start[short], end[short])
    edge = np.zeros(n + 1, np.int8)
    edge[first] += 1
    edge[first + count] -= 1
    return np.repeat(np.arange(len(start)), count), kernels.mix64(total[np.cumsum(edge[:n], dtype=np.int8).view(bool)])


def line_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, hash) of every shingle of lines in their normal form."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    end = np.cumsum(sizes)
    return _shingles(np.frombuffer(b"".join(lines), np.uint8), end - sizes, end)


class _Lines:
    """The lines with a word in one slice of texts: document, number and trimmed span of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = kernels.LOWER_ASCII[buf]
        feeds, docs = np.flatnonzero(buf == 0x0A), np.arange(len(offsets) - 1)
        before = np.searchsorted(feeds, offsets)
        opens, closes = before[:-1] + docs, before[1:] + docs  # a text of n feeds has n + 1 lines
        doc = np.repeat(docs, np.diff(before) + 1)
        start, end = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        start[opens], end[closes] = offsets[:-1], offsets[1:]
        of = np.arange(len(feeds)) + np.searchsorted(offsets, feeds, side="right") - 1
        start[of + 1], end[of] = feeds + 1, feeds
        _trim(buf, start, end)
        worded = np.flatnonzero(start < end)
        self.start, self.end, self.doc = start[worded], end[worded], doc[worded]
        self.number = worded - opens[self.doc]

    def digest(self, lane: int) -> np.ndarray:
        return kernels.span_hashes(self.buf, self.start, self.end, lane).view(np.int64)

    def classes(self, mixed: np.ndarray) -> np.ndarray:
        """The first digest of each line, or a number from both where that digest is among the ``mixed``, which different lines have."""
        h1 = self.digest(0)
        if len(mixed) and len(at := np.flatnonzero(np.isin(h1, mixed))):
            with np.errstate(over="ignore"):
                h1[at] = kernels.mix64(h1[at].view(np.uint64) + kernels.mix64(self.digest(1)[at].view(np.uint64))).view(np.int64)
        return h1


def _trim(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Move the bounds of lines to their first and behind their last character that is no blank; a blank line gets none."""
    for move, at in ((1, start), (-1, end)):
        here = min(move, 0)  # the byte before an end
        live = np.flatnonzero(start < end)
        for _ in range(TRIMS):
            live = live[start[live] < end[live]]
            live = live[kernels.BLANK[buf[at[live] + here]]]
            if not len(live):
                break
            at[live] += move
        live = live[start[live] < end[live]]
        if len(live):
            solid = np.flatnonzero(~kernels.BLANK[buf])
            if move > 0:
                at[live] = np.minimum(np.append(solid, len(buf))[np.searchsorted(solid, start[live])], end[live])
            else:
                at[live] = np.maximum(np.append(-1, solid)[np.searchsorted(solid, end[live])] + 1, start[live])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, _Lines]]:
    for row, _, buf, offsets in kernels.slices(batch.column(column)):
        yield row, _Lines(buf, offsets)


def line_table(docs: DataFrame, *, key: str, text: str, mixed: np.ndarray = _NONE) -> DataFrame:
    """A row per line with a word: key, digest (of the whole text), line_no, h1 and h2 (of the line); h1 is the line's class under ``mixed``."""
    few = docs.select(F.col(key), F.xxhash64(text).alias("digest"), F.col(text))
    kind = few.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lines in _slices(batch, text):
                at = pa.array(lines.doc + row)
                made = [pa.array(lines.number.astype(np.int32)), pa.array(lines.classes(mixed)), pa.array(lines.digest(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made], names=["key", "digest", "line_no", "h1", "h2"])

    return few.mapInArrow(run, f"key {kind}, digest bigint, line_no int, h1 bigint, h2 bigint")


def signatures(line: np.ndarray, shingle: np.ndarray, n_lines: int) -> np.ndarray:
    """Signature (n_lines x BINS) of each line: the least hash in every bin."""
    none = np.uint32(0xFFFFFFFF)
    at = (shingle >> np.uint64(32)) * np.uint64(BINS)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += line * BINS
    sig = np.full(n_lines * BINS, none)
    np.minimum.at(sig, at, shingle.astype(np.uint32))
    full = sig < none
    gap = np.flatnonzero(~full)
    column = gap % BINS
    for probe in _PROBES:
        if not len(gap):
            break
        other = gap - column + probe[column]
        hit = full[other]
        sig[gap[hit]] = sig[other[hit]]
        gap, column = gap[~hit], column[~hit]
    sig, full = sig.reshape(n_lines, BINS), full.reshape(n_lines, BINS)
    row = gap // BINS
    if len(row):  # a line of few shingles: the next full bin on the ring
        ring = np.where(np.concatenate((full, full), axis=1), np.arange(2 * BINS), 4 * BINS)
        following = np.minimum.accumulate(ring[:, ::-1], axis=1)[:, ::-1][row, column] % BINS
        sig[row, column] = sig[row, following]
    return sig


def _band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = kernels.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::ROWS].astype(np.uint64))
    return key


def _band_blocks(docs: DataFrame, text: str, parts: int, mixed: np.ndarray = _NONE) -> DataFrame:
    """The band keys of every line, once per slice of texts that holds it, as blocks (part, tokens, lines).

    A block holds packed keys of one of ``parts`` ranges and beside them the packed classes of
    their lines: tens of keys a line are cheaper to shuffle and to sort as arrays than as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lines_of, held = [], [], 0
        for batch in batches:
            for _, lines in _slices(batch, text):
                h1 = lines.classes(mixed)
                once = np.sort(np.unique(h1, return_index=True)[1])  # in order of the text, of which a chunk is a stretch
                for k in range(0, len(once), CHUNK):
                    part = once[k : k + CHUNK]
                    start, end = lines.start[part], lines.end[part]
                    keys = _band_keys(signatures(*_shingles(lines.buf[start[0] : end[-1]], start - start[0], end - start[0]), len(part)))
                    tokens.append(keys.ravel())
                    lines_of.append(np.repeat(h1[part], BANDS))
                    held += keys.size
                    if held >= KEYS_AT_ONCE:
                        yield _blocks(np.concatenate(tokens), np.concatenate(lines_of), parts)
                        tokens, lines_of, held = [], [], 0
        if held:
            yield _blocks(np.concatenate(tokens), np.concatenate(lines_of), parts)

    return docs.select(text).mapInArrow(run, "part int, tokens binary, lines binary")


def _blocks(token: np.ndarray, line: np.ndarray, parts: int) -> pa.RecordBatch:
    part = ((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    border = np.searchsorted(part[order], np.arange(parts + 1))
    filled = np.flatnonzero(border[1:] > border[:-1])
    cut = lambda x: pa.array([x[border[i] : border[i + 1]].tobytes() for i in filled], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), cut(token[order]), cut(line[order])], names=["part", "tokens", "lines"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, h1) of the keys that two lines hold; blocks arrive in order of their part.

    When as many new keys have come as are kept, and KEYS_AT_ONCE at least, those known to be shared
    are given out, of which their token alone is kept; so a key that very many lines hold takes no
    room, a part as much as it has different keys, and its keys are sorted a few times over, however
    many they are.  A row may come twice.
    """
    now, token, line, shared = None, [], [], np.zeros(0, np.uint64)
    kept = new = 0
    for batch in batches:
        for part, t, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != now or new >= max(4 * KEYS_AT_ONCE, kept):
                out, rest, shared = _settled(token, line, shared)
                yield out
                token, line, shared = ([], [], np.zeros(0, np.uint64)) if part != now else ([rest[0]], [rest[1]], shared)
                now, kept, new = part, sum(map(len, token)) + len(shared), 0
            token.append(np.frombuffer(t, np.uint64))
            line.append(np.frombuffer(h, np.int64))
            new += len(token[-1])
    yield _settled(token, line, shared)[0]


def _settled(tokens: list[np.ndarray], lines: list[np.ndarray], shared: np.ndarray):
    """The rows of shared keys, what is left, and the shared keys."""
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
    order = np.argsort(token)
    token, line = token[order], line[order]
    twin = np.zeros(len(token) + 1, dtype=bool)
    twin[1:-1] = token[1:] == token[:-1]
    often = (twin[1:] | twin[:-1]) | (np.isin(token, shared) if len(shared) else False)
    some, of = token[often], line[often]
    order = np.lexsort((of, some))
    some, of = some[order], of[order]
    once = np.concatenate(([True], (some[1:] != some[:-1]) | (of[1:] != of[:-1]))) if len(some) else np.zeros(0, bool)
    some, of = some[once], of[once]
    twin = np.zeros(len(some) + 1, dtype=bool)
    twin[1:-1] = some[1:] == some[:-1]
    keep = (twin[1:] | twin[:-1]) | (np.isin(some, shared) if len(shared) else False)
    rest = (np.concatenate((token[~often], some[~keep])), np.concatenate((line[~often], of[~keep])))
    out = pa.RecordBatch.from_arrays([pa.array(some[keep].view(np.int64)), pa.array(of[keep])], names=["token", "h1"])
    return out, rest, np.union1d(shared, some[keep])


def _candidates(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, a, b): of a key with at most SHORT_LIST lines their pairs a < b, of another its lines a without b, for all keys of :func:`_shared_keys`.

    Lines of a key wait for the end of its part until there are too many; then only its token is kept.
    """
    now, token, line, long = None, np.zeros(0, np.int64), _NONE, np.zeros(0, np.int64)
    for batch in _shared_keys(batches):
        if not batch.num_rows:
            continue
        t, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        part = ((int(t[0]) & 0xFFFFFFFFFFFFFFFF) >> 32) * parts >> 32
        if part != now:
            yield _pairs(token, line)
            now, token, line, long = part, t[:0], h[:0], t[:0]
        token, line = np.concatenate((token, t)), np.concatenate((line, h))
        order = np.lexsort((line, token))
        token, line = token[order], line[order]
        once = np.concatenate(([True], (token[1:] != token[:-1]) | (line[1:] != line[:-1])))
        token, line = token[once], line[once]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(first, len(token)))
        many = np.repeat((size > SHORT_LIST) | np.isin(token[first], long), size)
        long = np.union1d(long, token[many])
        yield _candidate_rows(token[many], line[many], None)
        token, line = token[~many], line[~many]
    yield _pairs(token, line)


def _pairs(token: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    """All pairs of the lines of each key, sorted by key and line; at most SHORT_LIST have one key."""
    left, right = [], []
    for k in range(1, SHORT_LIST):
        at = np.flatnonzero(token[k:] == token[:-k])
        left.append(at)
        right.append(at + k)
    left, right = np.concatenate(left), np.concatenate(right)
    return _candidate_rows(token[left], line[left], line[right])


def _candidate_rows(token: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["token", "a", "b"])


def _flags(hashes: DataFrame, most: int | None = None) -> np.ndarray:
    """Bytes with a bit for each value of the one bigint column, by its lowest bits."""
    bits = min(most or MOST_FLAGS, 1 << max(16, (FLAG_BITS * hashes.count()).bit_length()))
    at = F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST({} & 63 AS INT))".format(f"`{hashes.columns[0]}`")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, "<i8")
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _has_flag(h: np.ndarray, flags: np.ndarray) -> np.ndarray:
    at = h & np.int64(8 * len(flags) - 1)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _narrowed(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets in ``ids`` and few others, so that a join need not shuffle them all."""
    shared = sets.sparkSession.sparkContext.broadcast(_flags(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has_flag(batch.column(0).to_numpy(), shared.value)))

    return sets.mapInArrow(run, "cls bigint, data binary")


def _flagged_lines(docs: DataFrame, flags: np.ndarray, mixed: np.ndarray = _NONE) -> DataFrame:
    """Rows (place, h1, data) of the lines of ``docs`` (doc bigint, _text) whose document and place have a flag: a digest of document and line, the line's class, its normal form.

    Few others come along.  So texts, of which most is not wanted, are not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_has_flag(batch.column(0).to_numpy(), flags)))
            doc = batch.column(0).to_numpy()
            for row, lines in _slices(batch, "_text"):
                h1 = lines.classes(mixed)
                place = h1 ^ doc[lines.doc + row]
                at = np.flatnonzero(_has_flag(place, flags))
                at = at[np.unique(place[at], return_index=True)[1]]
                data = [lines.buf[a:b].tobytes() for a, b in zip(lines.start[at].tolist(), lines.end[at].tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (place, h1)), pa.array(data, pa.binary())], names=["place", "h1", "data"])

    return docs.mapInArrow(run, "place bigint, h1 bigint, data binary")


def _classes(lines: DataFrame) -> DataFrame:
    """A row per first digest of lines: cls, place (the first), n (rows), mixed (whether different lines share it)."""
    found = lines.groupBy(F.col("h1").alias("cls")).agg(F.min(F.struct("key", "line_no", "digest")).alias("place"), F.count("*").alias("n"), F.min("h2").alias("_low"), F.max("h2").alias("_high"))
    return found.select("cls", "place", "n", (F.col("_low") != F.col("_high")).alias("mixed"))


def similar_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", num: int = 3, den: int = 4, label: str = "line-dedup") -> DataFrame:
    """A row per line with a word: key, digest, line_no, first_key, first_line_no, kept.

    ``line_no`` counts the lines of the text from 0.  Lines link when intersection * den >=
    num * union of their shingle sets and a band brings them together; the line of a component with
    the smallest (key, line_no) is its first, and is kept.  Blank lines, null and empty texts give
    no rows.  Rows that repeat key and text are one document; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, label)
    lines = scratch.table(line_table(docs, key=key, text=text), "lines")
    first = scratch.table(_classes(lines), "first")
    mixed = first.filter("mixed").select("cls").toArrow().column(0).to_numpy()  # hardly ever any: 64 bits that different lines share
    if len(mixed):
        lines = scratch.table(line_table(docs, key=key, text=text, mixed=mixed), "lines-apart")
        first = scratch.table(_classes(lines), "first-apart")

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-first.count() * BANDS // (PARTS * KEYS_PER_PART)))
    parts = PARTS * tasks
    blocks = _band_blocks(docs, text, parts, mixed).repartition(tasks, "part").sortWithinPartitions("part")
    met = scratch.table(blocks.mapInArrow(lambda batches: _candidates(batches, parts), "token bigint, a bigint, b bigint"), "met")
    scratch.free()  # the keys of all lines, by far the most that lies on disk
    long = met.filter("b IS NULL").select("token", F.col("a").alias("cls"))
    rank = long.groupBy(F.col("cls").alias("_c")).agg(F.count("*").cast("double").alias("rank"))
    postings = long.join(rank, F.col("cls") == F.col("_c")).select("token", "cls", F.lit(1).alias("n"), "rank")

    def load(ids: DataFrame) -> DataFrame:
        wanted = first.join(ids.select(F.col("cls").alias("_w")), F.col("cls") == F.col("_w"), "left_semi")
        doc = F.xxhash64("place.key", "place.digest")
        wanted = scratch.table(wanted.select("cls", doc.alias("_doc"), F.col("cls").bitwiseXOR(doc).alias("_place")), "wanted")
        flags = _flags(wanted.select(F.explode(F.array("_doc", "_place")).alias("h")))
        found = _flagged_lines(docs.select(F.xxhash64(F.col(key), F.xxhash64(text)).alias("doc"), F.col(text).alias("_text")), flags, mixed)
        return found.join(wanted, (F.col("place") == F.col("_place")) & (F.col("h1") == F.col("cls"))).select("cls", "data")

    found_in = JaccardComponents(load, line_shingles, scratch, num, den, narrow=_narrowed).of(postings, met.filter("b IS NOT NULL").select("a", "b"))
    # Only a line that links with another or comes again has another first; for the rest it is their own.
    placed = first.join(found_in, F.col("cls") == F.col("node"), "left").filter("n > 1 OR node IS NOT NULL")
    placed = scratch.table(placed.select("cls", F.coalesce("component", "cls").alias("_part"), "place"), "placed")
    for name in ("met", "wanted", "first"):
        scratch.drop(name)
    least = placed.groupBy(F.col("_part").alias("_p")).agg(F.min("place").alias("_first"))
    moved = scratch.table(placed.join(least, F.col("_part") == F.col("_p")).select(F.col("cls").alias("_c"), "_first"), "moved")
    scratch.drop("placed")
    out = lines.join(moved, F.col("h1") == F.col("_c"), "left").withColumn("_first", F.coalesce("_first", F.struct("key", "line_no", "digest")))
    kept = F.col("key").eqNullSafe(F.col("_first.key")) & (F.col("line_no") == F.col("_first.line_no")) & (F.col("digest") == F.col("_first.digest"))
    return out.select(F.col("key").alias(key), "digest", "line_no", F.col("_first.key").alias(f"first_{key}"), F.col("_first.line_no").alias("first_line_no"), kept.alias("kept"))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that are not kept; a document that so loses its last line with a word goes.

    The columns of ``docs`` in order.  Documents that lose nothing, null texts among them, stay as they are.
    """
    found = similar_lines(docs, key=key, text=text)
    k, d, gone, some = unused(docs, "_k", "_d", "_lost", "_any")
    lost = found.groupBy(F.col(key).alias(k), F.col("digest").alias(d)).agg(F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))).alias(gone), F.max("kept").alias(some))
    lost = lost.filter(F.size(gone) > 0)
    joined = docs.join(lost, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(d)), "left").filter(F.coalesce(some, F.lit(True)))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined.withColumn(text, F.when(F.size(gone) > 0, left).otherwise(F.col(text))).select(*docs.columns)


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """Columns of :func:`similar_lines`, which states nulls, empty and repeated texts, ties and empty tables, without the digest."""
    return similar_lines(docs).drop("digest")
