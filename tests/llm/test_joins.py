"""Operators on pairs against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import embed_dedup, line_dedup, ngram_join
from beaconlake.llm.components import connected_components
from beaconlake.llm.scratch import Scratch
from tests.llm import brute


def test_ngram_components(docs, rows):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op6_ngram_join(docs).collect()}
    sets = [brute.word_shingles(t) for _, t, _ in rows]
    own = brute.components([k for k, _, _ in rows], sets)
    assert got == {(k, len(s), c) for (k, _, _), s, c in zip(rows, sets, own)}


def test_ngram_real_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    own = brute.components([r.doc_id for r in rows], [brute.word_shingles(r.text) for r in rows])
    assert {r.doc_id: r.component_id for r in ngram_join.op6_ngram_join(table).collect()} == {r.doc_id: c for r, c in zip(rows, own)}


def test_ngram_edges(null_docs, no_docs, spark):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op6_ngram_join(null_docs).collect()]
    assert sorted(found, key=repr) == sorted([(None, 3, None), (None, 3, None), (None, 0, None), (1, 3, 1)], key=repr)
    assert ngram_join.op6_ngram_join(no_docs).collect() == []
    assert ngram_join.deduplicate(null_docs).count() == 4


def test_ngram_drift_chains(spark):
    """Chains inside one long list: neighbours link, ends do not; components must still be whole."""
    rng = np.random.default_rng(5)
    texts = []
    for chain in range(3):
        base = [f"c{chain}w{i}" for i in range(100)]
        for i in range(60):
            texts.append(" ".join(base))
            at = int(rng.integers(0, 98))
            base[at] = f"z{chain}_{i}"
    shared = [f"s{i}" for i in range(70)]  # a common half, which alone links nobody
    for i in range(80):
        own = [f"o{i // 2}_{j}" for j in range(60)]
        own[0] = f"odd{i}"
        texts.append(" ".join(shared + own))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    own = brute.components(list(range(len(texts))), [brute.word_shingles(t) for t in texts])
    assert {r.doc_id: r.component_id for r in ngram_join.op6_ngram_join(table).collect()} == dict(enumerate(own))


def test_ngram_keeps_one_of_each(docs, rows):
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    own = brute.components([k for k, _, _ in rows], [brute.word_shingles(t) for _, t, _ in rows])
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for (k, _, _), c in zip(rows, own) if k == c}


def lines_of(rows):
    return [(k, i, line) for k, t, _ in dict.fromkeys(rows) for i, line in enumerate((t or "").split("\n")) if brute.WORD.search(line)]


def test_lines_against_brute_force(docs, rows):
    """No line is joined that brute force keeps apart; of the links few are missed, none between equal lines."""
    lines = lines_of(rows)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.op3_line_dedup(docs).collect()}
    assert set(got) == {(k, i) for k, i, _ in lines}
    trimmed = [brute.lower(line).strip(brute.BLANKS) for _, _, line in lines]
    classes = sorted(set(trimmed))
    at = {t: i for i, t in enumerate(classes)}
    sets = [brute.char_shingles(t) for t in classes]
    pairs = brute.links(sets)
    root = brute.roots(len(classes), pairs)
    first = {}
    for (k, i, _), t in zip(lines, trimmed):
        first[at[t]] = min(first.get(at[t], (k, i)), (k, i))
    place = {(k, i): at[t] for (k, i, _), t in zip(lines, trimmed)}
    for (k, i), (fk, fi, kept) in got.items():
        assert root[place[k, i]] == root[place[fk, fi]]
        assert kept == ((k, i) == (fk, fi))
        assert (fk, fi) <= first[place[k, i]]
    found = {c: got[k, i][:2] for (k, i), c in place.items()}
    assert len({(c, got[k, i][:2]) for (k, i), c in place.items()}) == len(classes)
    joined = sum(found[a] == found[b] for a, b in pairs)
    assert joined >= 0.98 * len(pairs)


def test_line_dedup_texts(docs, rows):
    found = {(r.doc_id, r.line_no): r.kept for r in line_dedup.op3_line_dedup(docs).collect()}
    want = {}
    for k, t, _ in rows:
        lines = (t or "").split("\n")
        left = [line for i, line in enumerate(lines) if found.get((k, i), True)]
        worded = [i for i, line in enumerate(lines) if brute.WORD.search(line)]
        if not worded or any(found[k, i] for i in worded):
            want[k] = None if t is None else "\n".join(left)
    out = line_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.select("doc_id", "text").collect()} == want


def test_line_edges(null_docs, no_docs):
    got = sorted((r.doc_id is None, r.line_no, r.kept) for r in line_dedup.op3_line_dedup(null_docs).collect())
    assert got == [(False, 0, False), (True, 0, True), (True, 0, True)]
    assert line_dedup.op3_line_dedup(no_docs).count() == 0
    assert line_dedup.deduplicate(no_docs).count() == 0


def vectors_brute(vecs: dict):
    keys = sorted(vecs)
    x = np.array([vecs[k] for k in keys], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = brute.roots(len(keys), list(zip(*np.nonzero(near))))
    return {k: (int(near[i].sum()), keys[root[i]]) for i, k in enumerate(keys)}


def test_embeddings_real_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = vectors_brute({r.vec_id: r.embedding for r in table.collect()})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.op1_embed_dedup(table).collect()}
    assert got == want


def test_embeddings_hot_bucket(spark):
    """One group larger than several blocks, equal vectors, and vectors that must stay alone."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    vecs = {i: (centre + rng.standard_normal(32) * 0.12).tolist() for i in range(900)}
    vecs |= {900 + i: centre.tolist() for i in range(50)}
    vecs |= {1000 + i: rng.standard_normal(32).tolist() for i in range(200)}
    rows = [(i, v, "x") for i, v in vecs.items()]
    rows += [(2000, None, ""), (2001, [0.0] * 32, ""), (2002, [float("nan")] * 32, ""), (2003, [1.0, None], ""), (2004, [], ""), (2005, [1.0, 2.0], ""), (None, centre.tolist(), ""), rows[3]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cls string").repartition(6)
    out = embed_dedup.near_duplicates(table, block=256).collect()
    got = {r.vec_id: (r.n_links, r.component) for r in out}
    want = vectors_brute(vecs)
    assert len(out) == len(vecs) + 7
    assert all(got[k][1] == want[k][1] for k in want)
    missed = sum(want[k][0] - got[k][0] for k in want)
    assert all(got[k][0] <= want[k][0] for k in want) and missed <= 0.001 * sum(n for n, _ in want.values())
    assert all(got[k] == (0, k) for k in range(2000, 2006)) and got[None] == (0, None)


def test_embeddings_empty(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embed_dedup.op1_embed_dedup(empty).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (9, 8), (3, 9), (20, 21), (21, 20), (None, 3)], [(i, i + 1) for i in range(60)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    nodes = sorted({x for e in real for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = brute.roots(len(nodes), [(at[a], at[b]) for a, b in real])
    assert got == {x: nodes[root[at[x]]] for x in nodes}
