"""Lines that are looked up again: those that are wanted come, and texts are not passed on for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from beaconlake.llm import line_dedup


def test_flagged_lines(spark):
    texts = ["\n".join(f"Line {j} of text {i} é" for j in range(30)) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Line of no key\nother"), (7, None), (8, "Line 3 of text 5 é"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    lines = line_dedup.line_table(docs, key="doc_id", text="text")
    doc = F.xxhash64("key", "digest")
    wanted = lines.filter("line_no = 3 AND key IN (5, 150) OR key IS NULL AND line_no = 0").select(doc.alias("doc"), F.col("h1").bitwiseXOR(doc).alias("place")).cache()
    flags = line_dedup._flags(wanted.select(F.explode(F.array("doc", "place")).alias("h")))
    found = line_dedup._flagged_lines(docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("doc"), F.col("text").alias("_text")), flags).collect()
    places = {r.place for r in wanted.collect()}
    assert sorted(bytes(r.data).decode() for r in found if r.place in places) == ["line 3 of text 150 é", "line 3 of text 5 é", "line of no key"]
    assert len(found) < 10


def test_flags_of_a_full_table(spark, monkeypatch):
    """The table of flags is bounded; when it is full, nothing that is wanted is missed."""
    monkeypatch.setattr(line_dedup, "MOST_FLAGS", 1 << 10)
    h = [int(x) for x in np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 500)] + [-1, 0, 63, 64]
    flags = line_dedup._flags(spark.createDataFrame([(x,) for x in h], "h bigint"))
    assert len(flags) == 128 and all(flags[(x & 1023) >> 3] >> (x & 7) & 1 for x in h)
    assert np.unpackbits(flags).sum() == len({x & 1023 for x in h})
