"""Components of sets under exact Jaccard links from candidate lists, without all pairs of a long list.

A posting says that a set holds a key (a rare token, a band of its signature).  Sets that share
a key are candidates:

* In a list of at most SHORT_LIST sets, groups of sets are paired, filtered by size and place,
  expanded to members and verified, by bitmaps of the sets first, which are much shorter.
* In a longer list every set is verified against one pivot.  Lists that share sets take the best
  pivot among them, so that a large group of near copies has one, and a set is compared with it
  once.  Most of a group so falls into one component, the home of its pivot.  What the pivot leaves
  open are the sets of a group in other components, the rest: they are compared with each other and
  with the home in blocks, inside a task, where a block of sets meets a block as one product of
  their shared tokens.  A block reports a spanning forest of its links, never pairs.

No pair of candidates that could join two components is lost, and rows grow with the postings; only
the rest of a group, not its home, multiplies blocks.  Pairs that only look alike grow with the square
of the input, so sets are laid beside pairs, and into blocks, in rounds of ROUND_BYTES.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.components import connected_components, forest
from beaconlake.llm.scratch import Scratch

SHORT_LIST = 6
BLOCK = 256
#: Columns of a product inside a block.
COLUMNS = 8192
BROADCAST_ROWS = 500_000
#: Bytes of sets that go through the shuffle beside pairs, or into blocks, at once; the files of a round are deleted before the next.
ROUND_BYTES = 1 << 30
#: Bits a token of a bitmap that stands for a set for the time of a check only.
BRIEF = 1.5


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if a count shows that it has at most ``rows`` rows (of a few numbers)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bitmap(tokens: np.ndarray, each: float = 4, least: int = 256) -> bytes:
    """A set of tokens as a bitmap of ``each`` to twice as many bits a token (a power of two, ``least`` to 32768 bits)."""
    bits = min(32768, max(least, 1 << int(each * len(tokens) - 1).bit_length())) if len(tokens) else least
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def overlap_bound(left: bytes, right: bytes, n_left: int, n_right: int) -> int:
    """At most so many tokens are common: a bit set on one side only stands for a token of that side only."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    only_a, only_b = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
    return min(n_left - only_a, n_right - only_b)


def packed_tokens(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, token) of sets stored as packed unsigned 64-bit tokens."""
    return np.repeat(np.arange(len(data)), [len(d) // 8 for d in data]), np.frombuffer(b"".join(data), np.uint64)


class JaccardComponents:
    """Components of sets that link when intersection * den >= num * union.

    ``load(ids)`` returns the sets in ``ids`` (one bigint column cls) as a DataFrame (cls bigint,
    data binary); ``tokens`` makes (number, token) of a list of such data, in order of the numbers;
    tokens are 64-bit hashes and may repeat.  ``sketches``, if
    given, is a DataFrame (cls, n, bits) with a :func:`bitmap` of every set, which rules out most
    candidates before sets are loaded.  Without them all sets of pairs are loaded, and brief bitmaps made
    of them; with ``narrow(sets, ids)``, which leaves out most sets that are not in ``ids``, blocks take
    these sets instead of loading theirs again.
    """

    def __init__(self, load: Callable[[DataFrame], DataFrame], tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], scratch: Scratch, num: int = 3, den: int = 4, sketches: DataFrame | None = None, narrow: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        self.load, self.tokens, self.scratch, self.num, self.den, self.sketches = load, tokens, scratch, num, den, sketches
        self.narrow = narrow if sketches is None else None

    def enough(self, overlap: Column, n_a: Column, n_b: Column) -> Column:
        return overlap * (self.num + self.den) >= (n_a + n_b) * self.num

    def sizes_fit(self, n_a: Column, n_b: Column) -> Column:
        return F.least(n_a, n_b) * self.den >= F.greatest(n_a, n_b) * self.num

    def of(self, postings: DataFrame, short: DataFrame | None = None) -> DataFrame:
        """(node, component) of every set that links with another: component is the smallest cls reachable.

        ``postings``: token bigint, cls bigint, n int (size of the set), pos int (place of the token
        in the set's order), gid bigint (group of sets with equal n and keys), rank double (the
        highest makes the best pivot).  One row per token and cls.  With ``short``, the pairs (a < b)
        of all lists of at most SHORT_LIST sets, postings are those of the longer lists only, and
        need no pos and gid.
        """
        t, drop = self.scratch.table, self.scratch.drop
        lists = postings.groupBy("token").agg(F.count("*").alias("cnt"), F.max(F.struct("rank", "cls", "n")).alias("top"))
        lists = lists.filter("cnt > 1").select(F.col("token").alias("_t"), "cnt", "top")
        listed = t(postings.join(lists, F.col("token") == F.col("_t")).drop("_t", "rank"), "listed")
        stars = t(self._stars(listed if short is not None else listed.filter(F.col("cnt") > SHORT_LIST)), "stars")
        pairs = short if short is not None else self._short_pairs(listed.filter(F.col("cnt") <= SHORT_LIST))
        fit = self.sizes_fit(F.col("n_pivot"), F.col("n"))
        pairs = pairs.unionByName(stars.filter(fit & (F.col("pivot") != F.col("cls"))).select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")))
        pairs = t(pairs.distinct(), "pairs")
        drop("listed")
        links, sets = self._linked(pairs)
        labels = t(connected_components(links, self.scratch, "stars-cc"), "labels")
        for name in ("pairs", "near", "links") if self.narrow else ("pairs", "near", "sets", "links"):
            drop(name)
        placed = t(self._blocks(stars, labels), "blocks")
        if placed.isEmpty():
            return labels
        ids = placed.select("cls").distinct()
        all_sets = sets if self.narrow else t(self.load(ids), "block-sets")
        sets = (self.narrow(sets, ids) if self.narrow else all_sets).withColumnRenamed("cls", "_c")
        tokens, num, den = self.tokens, self.num, self.den

        def linked(part: DataFrame) -> DataFrame:
            rows = part.join(sets, F.col("cls") == F.col("_c")).drop("_c")
            rows = rows.repartition("pivot", "i", "j", "home").sortWithinPartitions("pivot", "i", "j", "home")
            return rows.mapInArrow(lambda batches: _block_links(batches, tokens, num, den), "a bigint, b bigint")

        found = self._in_rounds(placed, ["pivot", "i", "j", "home"], _mean_bytes(all_sets, ["data"]), linked, "block-links")
        for name in ("stars", "blocks", "sets", "block-sets"):
            drop(name)
        if found.isEmpty():
            return labels
        # Links of blocks are between labels, so only those have to be joined, not all that they stand for.
        merged = t(connected_components(found, self.scratch, "blocks-cc").select(F.col("node").alias("_n"), F.col("component").alias("_m")), "merged")
        few = small_enough(merged)
        moved = labels.join(few, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_m", "component").alias("component"))
        alone = merged.join(labels.select("node"), F.col("_n") == F.col("node"), "left_anti")
        return t(moved.unionByName(alone.select(F.col("_n").alias("node"), F.col("_m").alias("component"))), "joined")

    def _stars(self, long: DataFrame) -> DataFrame:
        """(pivot, cls, n_pivot, n): every set of a long list beside the list's pivot; a pivot is beside itself.

        A list's pivot is the best among the pivots of all lists that its sets are in.
        """
        best = long.groupBy(F.col("cls").alias("_c")).agg(F.max("top").alias("best"))
        met = long.select("token", "cls", "n").join(best, F.col("cls") == F.col("_c"))
        led = met.groupBy(F.col("token").alias("_t")).agg(F.max("best").alias("led"))
        rows = long.select("token", "cls", "n").join(led, F.col("token") == F.col("_t"))
        own = F.struct(F.col("led.cls").alias("cls"), F.col("led.n").alias("n"))
        member = F.explode(F.array(own, F.struct("cls", "n")))
        return rows.select(F.col("led.cls").alias("pivot"), F.col("led.n").alias("n_pivot"), member.alias("m")).select("pivot", "m.cls", "n_pivot", "m.n").distinct()

    def _short_pairs(self, short: DataFrame) -> DataFrame:
        """Candidate pairs (a < b): pairs of groups, filtered, then their members."""
        groups = short.groupBy("token", "gid", "n").agg(F.min("pos").alias("pos"))
        x, y = groups.alias("x"), groups.alias("y")
        behind = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        fits = (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") <= F.col("y.gid")) & self.sizes_fit(F.col("x.n"), F.col("y.n")) & self.enough(behind, F.col("x.n"), F.col("y.n"))
        met = x.join(y, fits).select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
        members = short.select("gid", "cls").distinct()
        a = members.select(F.col("gid").alias("ga"), F.col("cls").alias("ca"))
        b = members.select(F.col("gid").alias("gb"), F.col("cls").alias("cb"))
        both = met.join(a, "ga").join(b, "gb").filter(F.col("ca") != F.col("cb"))
        return both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))

    def _linked(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs (a, b) that link, by bitmaps first, then by the sets of those that are left; and the sets that were loaded."""
        num, den, tokens, t = self.num, self.den, self.tokens, self.scratch.table
        ends = lambda some: some.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        keep = lambda x, y, n, m: overlap_bound(x, y, n, m) * (num + den) >= num * (n + m)
        sets, sketches = None, self.sketches
        if sketches is None:
            sets = t(self.load(ends(pairs)), "sets")
            sketches = t(sets.mapInArrow(lambda batches: _sketched(batches, tokens), "cls bigint, n int, bits binary"), "brief")
        near = self._beside_in_rounds(pairs, sketches, ["n", "bits"], _chosen(keep), "near")
        few = sets = t(self.load(ends(near)), "sets") if sets is None else sets
        if self.sketches is None:
            self.scratch.drop("brief")
            few = self.narrow(sets, ends(near)) if self.narrow else sets
        return self._beside_in_rounds(near, few, ["data"], lambda batches: _pair_links(batches, tokens, num, den), "links", sets), sets

    def _beside_in_rounds(self, pairs: DataFrame, sets: DataFrame, columns: list[str], check, name: str, all_sets: DataFrame | None = None) -> DataFrame:
        """The pairs that ``check`` leaves of those beside columns of the sets of both ends; ``all_sets`` are cheaper to measure than ``sets``."""
        size = 2 * _mean_bytes(sets if all_sets is None else all_sets, columns)
        return self._in_rounds(pairs, ["a", "b"], size, lambda part: _beside(part, sets, columns).mapInArrow(check, "a bigint, b bigint"), name)

    def _in_rounds(self, rows: DataFrame, by: list[str], size: float, made: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """What ``made`` makes of the rows, as a table, in as many rounds as their number and ``size`` bytes each ask for; rows equal in ``by`` share a round."""
        rounds = max(1, math.ceil(rows.count() * size / ROUND_BYTES))
        self.scratch.free()
        parts = []
        for k in range(rounds):
            parts.append(self.scratch.table(made(rows if rounds == 1 else rows.filter(F.pmod(F.xxhash64(*by), F.lit(rounds)) == k)), f"{name}/{k}"))
            self.scratch.free()
        return reduce(DataFrame.unionByName, parts)

    def _blocks(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows (pivot, i, j, home, cls, label) of every set in every pair of blocks that it is compared in.

        In the group of a pivot the sets of its largest component are the home, the others the rest.
        Blocks of the rest meet each other (home false, i <= j) and the blocks of the home (true).
        """
        labelled = stars.join(labels, F.col("cls") == F.col("node"), "left").select("pivot", "cls", F.coalesce("component", "cls").alias("label"))
        labelled = self.scratch.table(labelled, "labelled")
        held = labelled.groupBy("pivot", "label").agg(F.count("*").alias("k"))
        home = held.groupBy(F.col("pivot").alias("_p")).agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all")).filter("all > top.k")
        parts = lambda n: F.ceil(n / BLOCK).cast("int")
        home = home.select("_p", F.col("top.label").alias("_h"), parts(F.col("all") - F.col("top.k")).alias("rests"), parts(F.col("top.k")).alias("homes"))
        rows = labelled.join(small_enough(self.scratch.table(home, "homes")), F.col("pivot") == F.col("_p"))
        inside = F.col("label") == F.col("_h")
        own = F.pmod(F.xxhash64("cls"), F.when(inside, F.col("homes")).otherwise(F.col("rests"))).cast("int")
        rows = rows.select("pivot", "cls", "label", inside.alias("inside"), own.alias("own"), "rests", "homes")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        place = lambda i, j, home: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(home).alias("home"))
        mine = F.col("own")
        with_home = F.transform(every("homes"), lambda k: place(mine, k, True))
        with_rest = F.transform(every("rests"), lambda k: place(F.least(mine, k), F.greatest(mine, k), False))
        under_rest = F.transform(every("rests"), lambda k: place(k, mine, True))
        rows = rows.withColumn("at", F.explode(F.when(F.col("inside"), under_rest).otherwise(F.concat(with_home, with_rest))))
        return rows.select("pivot", "at.i", "at.j", "at.home", "cls", "label")


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the columns of both ends.  The possibly hot end a is joined first, while rows are short."""
    a = sets.select(F.col("cls").alias("_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = sets.select(F.col("cls").alias("_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    rows = pairs.select("a", "b").join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    return rows.drop("_a", "_b")


def _mean_bytes(sets: DataFrame, columns: list[str]) -> float:
    """Bytes of the columns of a set, on average."""
    return sets.agg(F.avg(sum((F.octet_length(c) for c in columns if c != "n"), F.lit(0)))).first()[0] or 0.0


def _sketched(batches: Iterator[pa.RecordBatch], tokens) -> Iterator[pa.RecordBatch]:
    """Rows (cls, n, bits) of sets: how many tokens, and a brief bitmap."""
    for batch in batches:
        n, bits = [], []
        for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
            data = batch.column(1).slice(at, PAIRS_AT_ONCE).to_pylist()
            owner, token = tokens(data)
            border = np.searchsorted(owner, np.arange(len(data) + 1))
            for a, b in zip(border[:-1], border[1:]):
                own = np.unique(token[a:b])
                n.append(len(own))
                bits.append(bitmap(own, BRIEF, 64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(bits, pa.binary())], names=["cls", "n", "bits"])


def _chosen(keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            mask = [keep(x, y, n, m) for x, y, n, m in zip(c["bits_a"], c["bits_b"], c["n_a"], c["n_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return run


PAIRS_AT_ONCE = 128


def _pair_links(batches: Iterator[pa.RecordBatch], tokens, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
            part = batch.slice(at, PAIRS_AT_ONCE)
            n, both = _pair_overlaps(part.column("data_a").to_pylist(), part.column("data_b").to_pylist(), tokens)
            yield part.select(["a", "b"]).filter(pa.array(both * (num + den) >= num * n))


def _pair_overlaps(left: list[bytes], right: list[bytes], tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sets the sum of their sizes and the number of their common tokens.

    Sets that several pairs hold are made once.  A token becomes one number of pair, token and side,
    so that one sort brings what is common side by side; it keeps 54 bits of the token, of the some
    hundreds or thousands that a pair has.
    """
    known = {d: i for i, d in enumerate(dict.fromkeys([*left, *right]))}
    owner, token = tokens(list(known))
    border = np.searchsorted(owner, np.arange(len(known) + 1))
    sides = np.array([[known[d] for d in left], [known[d] for d in right]])
    count = (border[1:] - border[:-1])[sides].ravel()
    flat = np.arange(count.sum()) + np.repeat(border[:-1][sides].ravel() - (np.cumsum(count) - count), count)
    pair, side = np.tile(np.arange(len(left), dtype=np.uint64), 2), np.repeat(np.arange(2, dtype=np.uint64), len(left))
    keys = ((token >> np.uint64(10)) << np.uint64(1))[flat]
    keys |= np.repeat((pair << np.uint64(55)) | side, count)
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    same = (keys[1:] ^ keys[:-1]) == np.uint64(1)
    of = (keys >> np.uint64(55)).astype(np.int64)
    return np.bincount(of, minlength=len(left)), np.bincount(of[1:][same], minlength=len(left))


def _block_links(batches: Iterator[pa.RecordBatch], tokens, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links between different labels, as pairs of labels, in each run of rows of one (pivot, i, j, home)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("pivot", "i", "j", "home")])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield from _forest_of(table.slice(a, b - a), tokens, num, den)
        held = table.slice(cuts[-1] if cuts else 0)  # the last run may go on; it has at most two blocks
    if held is not None:
        yield from _forest_of(held, tokens, num, den)


def _forest_of(run: pa.Table, tokens, num: int, den: int) -> Iterator[pa.RecordBatch]:
    if run.num_rows < 2:
        return
    label = run.column("label").to_numpy()
    owner, flat = tokens(run.column("data").to_pylist())
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    once = np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))) if len(flat) else np.zeros(0, bool)
    flat, owner = flat[once], owner[once]
    n = np.bincount(owner, minlength=run.num_rows)
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, fresh = owner[shared], fresh[shared]
    column = np.cumsum(fresh) - 1
    overlap = np.zeros((len(n), len(n)), dtype=np.float64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(column, column[at] + COLUMNS))
        grid = np.zeros((len(n), COLUMNS), dtype=np.float32)
        grid[owner[at:to], column[at:to] - column[at]] = 1
        overlap += grid @ grid.T
        at = to
    near = (overlap * (num + den) >= num * (n[:, None] + n[None, :])) & (label[:, None] < label[None, :])
    child, root = forest(*np.nonzero(near), len(n))
    if len(child):
        yield pa.RecordBatch.from_arrays([pa.array(label[child]), pa.array(label[root])], names=["a", "b"])
