"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors first collapse into one class.  Each table signs a class with its own hyperplanes;
classes that share a bucket of any table are candidates and are compared in double precision.  The
number of planes grows with the logarithm of the classes, so that chance company in a bucket stays
rare, and the number of tables follows from the recall wanted at the threshold.

Only (bucket, class) goes through the shuffle of the tables.  A bucket of at most SMALL classes
gives its pairs.  Larger buckets are joined to clusters where they share classes, and a cluster is
compared once, not once a table: its classes are cut into blocks of at most BLOCK, and every pair
of blocks is a group of its own that fetches its vectors.  A block reports counts and a spanning
forest of its links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm import kernels
from beaconlake.llm.components import connected_components, forest
from beaconlake.llm.scratch import Scratch
from beaconlake.llm.setjoin import small_enough

THRESHOLD = 0.95
RECALL = 0.9998
BLOCK = 512
SMALL = 32
_SEED = 20240229


def table_plan(n_classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Planes per table and number of tables: a pair at the threshold is found with probability ``recall``."""
    planes = min(32, max(6, math.ceil(math.log2(max(n_classes, 2))) + 3))
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def signatures(vectors: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """Sign codes (rows x tables) of the vectors; hyperplanes depend on the dimension only."""
    normals = np.random.default_rng(_SEED + vectors.shape[1]).standard_normal((vectors.shape[1], planes * tables))
    signs = (vectors @ normals > 0).reshape(len(vectors), tables, planes)
    return (signs * (1 << np.arange(planes, dtype=np.uint64))).sum(axis=2).astype(np.uint64)


def _packed(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, vec): packed components, 32-bit ones as such; null where the vector cannot link with any."""
    few = vectors.select(key, column)
    kind = few.schema[0].dataType.simpleString()
    item = np.dtype("<f4") if few.schema[1].dataType.simpleString() == "array<float>" else np.dtype("<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                a = np.array(v, dtype=item) + item.type(0) if ok else None  # -0.0 becomes 0.0
                out.append(a.tobytes() if ok and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "vec"])

    return few.mapInArrow(run, f"key {kind}, vec binary").withColumn("wide", F.lit(item.itemsize == 8))


def _matrix(rows: list[bytes], wide: bool) -> np.ndarray:
    """Vectors of one dimension as doubles, each scaled by its largest component so that no sum of squares overflows."""
    matrix = np.frombuffer(b"".join(rows), "<f8" if wide else "<f4").reshape(len(rows), -1).astype(np.float64)
    return matrix / np.abs(matrix).max(axis=1, keepdims=True)


def _buckets(classes: DataFrame, planes: int, tables: int) -> DataFrame:
    """A row (bucket, cls) per class and table; table, code and dimension make the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, wide = batch.column("vec").to_pylist(), batch.column("wide").to_pylist()
            sizes = np.array([len(v) for v in vec])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), 1024):
                    part = own[at : at + 1024]
                    codes = signatures(_matrix([vec[i] for i in part], wide[0]), planes, tables)
                    with np.errstate(over="ignore"):
                        place = kernels.mix64(np.arange(tables, dtype=np.uint64) + np.uint64(int(size)) * np.uint64(1 << 20))
                        keys = kernels.mix64(codes + place[None, :])
                    cls = batch.column("cls").take(pa.array(np.repeat(part, tables)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), cls], names=["bucket", "cls"])

    return classes.select("cls", "vec", "wide").mapInArrow(run, "bucket bigint, cls bigint")


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    return (left @ right.T) / (norm(left)[:, None] * norm(right)[None, :])


def _pair_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of the pairs (a, b, vec_a, vec_b) those that link."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            left, right, wide = (part.column(c).to_pylist() for c in ("vec_a", "vec_b", "wide_a"))
            sizes = np.array([len(v) if len(v) == len(w) else 0 for v, w in zip(left, right)])
            near = np.zeros(len(left), dtype=bool)
            for size in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == size)
                x, y = _matrix([left[i] for i in own], wide[0]), _matrix([right[i] for i in own], wide[0])
                near[own] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= threshold
            yield part.select(["a", "b", "m_a", "m_b"]).filter(pa.array(near))


def _block_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links inside each run of rows of one (cluster, dim, i, j); rows arrive in that order."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("cluster", "dim", "i", "j")])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield from _links_of(table.slice(a, b - a), threshold)
        held = table.slice(cuts[-1] if cuts else 0)  # the last run may go on; it has at most two blocks
    if held is not None:
        yield from _links_of(held, threshold)


def _links_of(run: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    if run.num_rows < 2:
        return
    cls, m, side = (run.column(c).to_numpy() for c in ("cls", "m", "side"))
    x = _matrix(run.column("vec").to_pylist(), bool(run.column("wide")[0].as_py()))
    near = np.triu(_cosines(x, x) >= threshold, 1)
    if run.column("i")[0].as_py() != run.column("j")[0].as_py():  # two blocks: each is compared with itself elsewhere
        near &= side[:, None] != side[None, :]
    p, q = np.nonzero(near)
    counts = np.bincount(p, weights=m[q], minlength=len(cls)) + np.bincount(q, weights=m[p], minlength=len(cls))
    root = np.arange(len(cls))
    child, top = forest(p, q, len(cls))
    root[child] = top
    linked = np.flatnonzero(counts > 0)
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(cls[root[linked]]), pa.array(counts[linked].astype(np.int64))], names=["cls", "root", "links"])


def near_duplicates(
    vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, small: int = SMALL, label: str = "embeddings"
) -> DataFrame:
    """One row per vector: key, n_links, component.

    Two vectors link when their cosine, in double precision, is at least ``threshold`` and a table
    brings them together.  Null, empty, zero vectors and vectors with null or non-finite components
    link with nothing; so do vectors of different dimensions.  Rows that repeat a key are one
    vector (the first in byte order, usable ones before unusable).  Equal vectors of different keys
    link.  An empty table gives no rows.  ``key`` is bigint; every row with a null key is a vector
    of its own, without an identity: it links with nothing and its component is null.
    """
    scratch = Scratch(vectors.sparkSession, label)
    t = scratch.table
    packed = t(_packed(vectors, key, column), "packed")
    rows = packed.filter("key IS NOT NULL").groupBy("key", "wide").agg(F.min("vec").alias("vec")).withColumn("digest", F.sha2("vec", 256))
    rows = t(rows, "vectors")
    nameless = packed.filter("key IS NULL").select("key")
    usable = rows.filter("vec IS NOT NULL")
    heads = usable.groupBy("digest").agg(F.min("key").alias("cls"), F.count("*").alias("m"))
    own = heads.join(usable.select(F.col("key").alias("_k"), "vec", "wide"), F.col("cls") == F.col("_k")).drop("_k")
    classes = t(own, "classes")
    planes, tables = table_plan(classes.count(), threshold, recall)
    counts = _buckets(classes, planes, tables).groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("head")).filter("n > 1")
    counts = t(counts.withColumnRenamed("bucket", "_b"), "buckets")
    met = t(_buckets(classes, planes, tables).join(counts, F.col("bucket") == F.col("_b")).drop("_b"), "met")

    crowded = met.filter(F.col("n") > small)
    clusters = connected_components(crowded.select(F.col("cls").alias("a"), F.col("head").alias("b")), scratch, "clusters")
    clusters = t(clusters.select(F.col("node").alias("_n"), F.col("component").alias("cluster")), "clusters")
    sizes = clusters.groupBy(F.col("cluster").alias("_c")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))

    few = met.filter(F.col("n") <= small).select("bucket", "cls")
    pairs = few.join(few.select(F.col("bucket").alias("_b"), F.col("cls").alias("b")), (F.col("bucket") == F.col("_b")) & (F.col("cls") < F.col("b"))).select(F.col("cls").alias("a"), "b").distinct()
    of_a, of_b = clusters.select(F.col("_n").alias("_a"), F.col("cluster").alias("_ca")), clusters.select(F.col("_n").alias("_b"), F.col("cluster").alias("_cb"))
    apart = pairs.join(of_a, F.col("a") == F.col("_a"), "left").join(of_b, F.col("b") == F.col("_b"), "left").filter("_ca IS NULL OR _cb IS NULL OR _ca != _cb").select("a", "b")
    ends = [classes.select(F.col("cls").alias(f"_{s}"), F.col("vec").alias(f"vec_{s}"), F.col("m").alias(f"m_{s}"), F.col("wide").alias(f"wide_{s}")) for s in "ab"]
    beside = apart.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).drop("_a", "_b", "wide_b")
    linked = t(beside.mapInArrow(lambda batches: _pair_links(batches, threshold), "a bigint, b bigint, m_a bigint, m_b bigint"), "pairs")
    both = [linked.select(F.col("a").alias("cls"), F.col("b").alias("root"), F.col("m_b").alias("links")), linked.select(F.col("b").alias("cls"), F.col("a").alias("root"), F.col("m_a").alias("links"))]

    placed = clusters.join(small_enough(t(sizes, "sizes")), F.col("cluster") == F.col("_c")).withColumn("side", F.pmod(F.xxhash64("_n"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("_n", "cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    full = placed.join(classes, F.col("_n") == F.col("cls")).select("cluster", F.octet_length("vec").alias("dim"), "i", "j", "side", "cls", "m", "vec", "wide")
    grouped = full.repartition("cluster", "dim", "i", "j").sortWithinPartitions("cluster", "dim", "i", "j")
    blocks = t(grouped.mapInArrow(lambda batches: _block_links(batches, threshold), "cls bigint, root bigint, links bigint"), "blocks")

    found = blocks.unionByName(both[0]).unionByName(both[1])
    totals = t(found.groupBy(F.col("cls").alias("_c")).agg(F.sum("links").alias("links")), "counts")
    parts_of = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    named = classes.select("digest", "cls", "m").join(totals, F.col("cls") == F.col("_c"), "left").join(parts_of, F.col("cls") == F.col("node"), "left")
    named = t(named.select(F.col("digest").alias("_d"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")), "named")
    for name in ("buckets", "met", "clusters", "sizes", "pairs", "blocks", "counts", "classes"):
        scratch.drop(name)
    out = rows.select("key", "digest").unionByName(nameless.withColumn("digest", F.lit(None).cast("string"))).join(named, F.col("digest") == F.col("_d"), "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "key").alias("component"))


def op1_embed_dedup(vectors: DataFrame) -> DataFrame:
    """Contract columns of :func:`near_duplicates`, which states null and odd vectors, repeats and empty tables; null keys link with nothing."""
    found = near_duplicates(vectors)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
