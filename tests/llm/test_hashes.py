"""Texts of few letters in regular patterns (Thue-Morse words and their complements) are told apart everywhere."""

from __future__ import annotations

import numpy as np

from beaconlake.llm import kernels, line_dedup, ngram_join, quality, substring


def thue_morse(order: int, a: str, b: str) -> tuple[list[str], list[str]]:
    bits = [bin(i).count("1") & 1 for i in range(1 << order)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_kernels():
    for order in (10, 12, 14):
        one, other = ("".join(x).encode() for x in thue_morse(order, "a", "b"))
        buf = np.frombuffer(one + other + one, np.uint8)
        at = np.arange(3) * len(one)
        for lane in (0, 1):
            h = kernels.span_hashes(buf, at, at + len(one), lane)
            assert h[0] == h[2] != h[1]
        words = kernels.span_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
        values = words[(np.frombuffer(one + other + one, np.uint8) == ord("b")).astype(int)]
        h = kernels.sequence_hashes(values, at, at + len(one))
        assert h[0] == h[2] != h[1]


def test_spans_of_all_sizes():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.repeat(np.arange(380), 20)
    end = start + np.tile(np.arange(1, 21), 380)
    h = kernels.span_hashes(raw, start, end)
    text = raw.tobytes().decode()
    assert len(dict(zip(h.tolist(), (text[a:b] for a, b in zip(start, end))))) == len({text[a:b] for a, b in zip(start, end)}) == len(set(h.tolist()))
    assert (kernels.span_hashes(raw, start, end, 1) != h).all()
    assert len(kernels.span_hashes(raw[:0], start[:0], end[:0])) == 0


def test_operators(spark):
    one, other = ("".join(x) for x in thue_morse(12, "a", "b"))
    words, changed = (" ".join(x) for x in thue_morse(12, "p", "q"))
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one), (2, other), (3, f"{body}\n{one}\n{other}"), (4, words), (5, changed)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id bigint, text string, source string")
    dup = {r.doc_id: r.n_dup_lines for r in quality.op4_quality(docs).collect()}
    assert dup[3] == 0
    assert {r.doc_id: r.component_id for r in ngram_join.op6_ngram_join(docs.filter("doc_id < 3")).collect()} == {1: 1, 2: 2}
    kept = {(r.doc_id, r.line_no): r.first_doc_id for r in line_dedup.op3_line_dedup(docs.filter("doc_id IN (1, 2)")).collect()}
    digests = line_dedup.line_table(docs.filter("doc_id < 3"), key="doc_id", text="text").select("h1", "h2").collect()
    assert len(set(digests)) == 2 and kept.keys() == {(1, 0), (2, 0)}
    gone = {r.doc_id for r in substring.repeated_spans(docs, unit="line", min_words=1).collect()}
    assert gone == {3}
    assert {r.doc_id for r in substring.repeated_spans(docs.filter("doc_id > 3"), unit="line", min_words=1).collect()} == set()
