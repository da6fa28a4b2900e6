"""Line dedup on ordinary lines of 30 to 80 characters with one character or word changed."""

from __future__ import annotations

import random

from beaconlake.llm import line_dedup, registry
from tests.llm import brute


def planted() -> list[tuple[str, str, str]]:
    """(kind, line, changed line): one character or one word of 3 letters, well inside the line."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for n in range(30, 81):
        for _ in range(3):
            words: list[str] = []
            while len(" ".join(words)) < n:
                words.append("".join(rng.choices(letters, k=rng.choice([3, 4, 6, 8]))))
            line = " ".join(words)[:n].strip()
            at = rng.choice([i for i in range(12, len(line) - 12) if line[i] != " "])
            out.append(("char", line, line[:at] + "#" + line[at + 1 :]))
            parts = line.split(" ")
            inner = len(parts) // 2
            parts[inner] = "new"
            out.append(("word", line, " ".join(parts)))
    return out


def test_changed_lines(spark, tmp_path):
    cases = planted()
    rows = [(2 * i, line) for i, (_, line, _) in enumerate(cases)] + [(2 * i + 1, other) for i, (*_, other) in enumerate(cases)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["op3_line_dedup"](spark, str(tmp_path)).collect()
    first = {r.doc_id: r.first_doc_id for r in found}
    keys, lines = [k for k, _ in rows], [line for _, line in rows]
    want = dict(zip(keys, brute.components(keys, [brute.char_shingles(line, 5) for line in lines])))
    # No pair is joined that the exact Jaccard keeps apart; banding may miss few.
    assert all(want[k] == want[f] for k, f in first.items())
    assert sum(first[k] == want[k] for k in keys) >= 0.99 * len(keys)
    # One character breaks five shingles: from 39 characters on such copies have 3/4 in common.
    chars = [i for i, (kind, line, _) in enumerate(cases) if kind == "char" and len(line) >= 39]
    joined = sum(first[2 * i + 1] == first[2 * i] for i in chars)
    assert len(chars) > 100 and joined >= 0.98 * len(chars)
    assert any(kind == "word" and len(line) < 79 and first[2 * i + 1] == first[2 * i] for i, (kind, line, _) in enumerate(cases))
    kept = line_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}
