"""Steps of line dedup: how lines are cut, which candidates a key gives, and what is passed on for lines that nothing links with."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import kernels, line_dedup
from beaconlake.llm.scratch import Scratch


def test_lines_are_cut_as_split_and_strip(monkeypatch):
    rng = random.Random(6)
    texts = ["", "\n", " " * 50 + "X" + "\t" * 70 + "\n" + " " * 99, "é\n\n ü "]
    texts += ["".join(rng.choices("aB é\n \t\r\x0b\n", k=rng.randrange(60))) + " " * rng.choice([0, 0, 40]) for _ in range(2000)]
    monkeypatch.setattr(kernels, "SLICE_BYTES", 300)
    got = []
    for row, lines in line_dedup._slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t"):
        got += [(row + d, n, lines.buf[a:b].tobytes().decode()) for d, n, a, b in zip(lines.doc.tolist(), lines.number.tolist(), lines.start.tolist(), lines.end.tolist())]
    want = [(i, n, x.strip(" \t\n\x0b\x0c\r").replace("B", "b").replace("X", "x")) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    assert got == [x for x in want if x[2]]


@pytest.mark.parametrize("at_once", [1 << 18, 16])
def test_candidates(monkeypatch, at_once):
    """All pairs of short lists, all lines of long ones, also where a part is settled again and again."""
    monkeypatch.setattr(line_dedup, "KEYS_AT_ONCE", at_once)
    rng = np.random.default_rng(8)
    held = {int(t): set(rng.integers(-(1 << 62), 1 << 62, n).tolist()) for t, n in zip(rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2), [1, 2, 3, 6, 7, 40] * 15)}
    rows = [(t, h) for t, lines in held.items() for h in [*lines, *lines]]
    rng.shuffle(rows)
    token, line = np.array([t for t, _ in rows], np.uint64), np.array([h for _, h in rows], np.int64)
    blocks = pa.Table.from_batches([line_dedup._blocks(token[i : i + 20], line[i : i + 20], 5) for i in range(0, len(token), 20)]).sort_by("part")
    got = [(t % (1 << 64), a, b) for x in line_dedup._candidates(iter(blocks.to_batches(max_chunksize=3)), 5) for t, a, b in zip(*(x.column(i).to_pylist() for i in range(3)))]
    pairs = [x for x in got if x[2] is not None]
    assert sorted(pairs) == sorted((t, *p) for t, lines in held.items() if len(lines) <= line_dedup.SHORT_LIST for p in combinations(sorted(lines), 2))
    assert {x[:2] for x in got if x[2] is None} == {(t, h) for t, lines in held.items() if len(lines) > line_dedup.SHORT_LIST for h in lines}


def corpus(spark, n: int):
    rng = random.Random(9)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    hot = say(15)
    texts = ["\n".join(say(12) for _ in range(10)) for _ in range(n)] + [hot + f" {i % 5}\n{hot}" for i in range(30)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)


def test_lines_without_copies_are_not_passed_on(spark, monkeypatch):
    """Beyond the lines and their classes, tables hold lines that have candidates, not all lines."""
    kept = Scratch.table
    rows: dict[str, int] = {}

    def table(self, df, name):
        out = kept(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "table", table)
    found = line_dedup.op3_line_dedup(corpus(spark, 300)).collect()
    assert rows["lines"] == len(found) == 3060 and rows["first"] == 3006
    assert max(n for name, n in rows.items() if name not in ("lines", "first")) < 1000
    assert sum(not r.kept for r in found) == 59


def test_different_lines_of_one_digest(spark, monkeypatch):
    """Lines whose first digest is shared take both digests as their number, with the same result."""
    docs = corpus(spark, 40)
    want = sorted(line_dedup.op3_line_dedup(docs).collect())
    classes, calls = line_dedup._classes, []

    def mixed(lines):
        calls.append(1)
        out = classes(lines)
        return out.withColumn("mixed", F.pmod("cls", F.lit(2)) == 0) if len(calls) == 1 else out

    monkeypatch.setattr(line_dedup, "_classes", mixed)
    assert sorted(line_dedup.op3_line_dedup(docs).collect()) == want and len(calls) == 2
    lines = line_dedup.line_table(docs, key="doc_id", text="text")
    digest = lines.first().h1
    renamed = line_dedup.line_table(docs, key="doc_id", text="text", mixed=np.array([digest]))
    assert renamed.filter(F.col("h1") == digest).count() == 0 and renamed.select("h1").distinct().count() == lines.select("h1").distinct().count()
