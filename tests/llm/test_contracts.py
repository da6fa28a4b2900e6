"""Cases the contracts of the operators name: planted pairs near a threshold, null and repeated keys, groups of equal texts."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import AddedToken, Tokenizer

from beaconlake.llm import bpe, embed_dedup, mixing, shards, token_rollup
from beaconlake.llm.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_embeddings_recall_at_the_threshold(spark):
    """Pairs with a cosine of 0.950 to 0.955, each alone among random vectors: at least 0.99 of them are found, none below 0.95."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(600):
        x = rng.standard_normal(48)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(48)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cos = rng.uniform(0.9501, 0.955) if i % 3 else rng.uniform(0.94, 0.9499)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (cos * x + np.sqrt(1 - cos**2) * y).tolist())]
        want[i] = cos >= 0.95
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embed_dedup.op1_embed_dedup(table).collect()}
    found = {i for i in want if got[2 * i + 1].component_id == 2 * i}
    assert not {i for i in found if not want[i]}
    assert len(found) >= 0.99 * sum(want.values())
    assert all(got[2 * i].n_links == got[2 * i + 1].n_links == int(i in found) for i in want)


def test_embeddings_null_keys_and_dimensions(spark):
    rng = np.random.default_rng(3)
    long = rng.standard_normal(20).tolist()
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, long), (4, [x * 3 for x in long]), (5, long[:2])]
    got = embed_dedup.op1_embed_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter({(None, 0, None, True): 3, (1, 1, 1, True): 1, (2, 1, 1, False): 1, (3, 1, 3, True): 1, (4, 1, 3, False): 1, (5, 0, 5, True): 1})


def test_embeddings_clusters(spark):
    """Groups over several blocks next to pairs in small buckets: counts equal brute force up to few misses, components all."""
    rng = np.random.default_rng(8)
    vecs = {}
    for g in range(3):
        centre = rng.standard_normal(24)
        for i in range(150):
            vecs[g * 1000 + i] = (centre + rng.standard_normal(24) * 0.1).tolist()
    vecs |= {5000 + i: rng.standard_normal(24).tolist() for i in range(300)}
    table = spark.createDataFrame(list(vecs.items()), "vec_id bigint, embedding array<double>").repartition(5)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(table, block=40, small=8).collect()}
    x = np.array(list(vecs.values()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    true = dict(zip(vecs, near.sum(axis=1).tolist()))
    assert all(got[k].n_links <= n for k, n in true.items())
    assert sum(got[k].n_links for k in true) >= 0.998 * sum(true.values())
    assert all((got[k].component == k) == (not near[i, : i].any()) or near[i].any() for i, k in enumerate(vecs))


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_keep_equal_texts(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, int(rng.integers(5, 60)))) for _ in range(3000)]
    rows = list(enumerate(texts))
    for g, copies in enumerate((2, 2, 3, 10, 40, 60)):
        rows += [(10_000 + 100 * g + i, f"copied text {g} " * 20) for i in range(copies)]
    rows += [(20_000 + i, "a third of the bytes " * 10) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = shards.op8_shards(table).collect()
    total, of = Counter(), defaultdict(set)
    text = dict(rows)
    for r in got:
        total[r.shard] += r.size
        of[text[r.doc_id]].add(r.shard)
    fair = sum(total.values()) / 40
    group = {t: sum(len(x.encode()) + 16 for x in text.values() if x == t) for t in of if len(of[t]) > 1}
    assert all(size > fair for size in group.values())  # only what outweighs a shard is divided
    assert set(total) == set(range(40)) and min(total.values()) >= 0.85 * fair and max(total.values()) <= 1.15 * fair


def test_mix_keeps_every_row(spark):
    rows = [(1, "a b c", "s", i) for i in range(5)] + [(None, "d e", "s", i) for i in range(7)] + [(2, "x " * 40, "t", 0), (3, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _k int").repartition(3)
    plan = mixing.plan_copies(docs).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert {r.doc_id: r.source_size for r in plan} == {1: 29, None: 29, 2: 40, 3: 0}
    again = Counter(map(tuple, mixing.mix(docs).collect()))
    assert again == Counter(map(tuple, mixed.collect()))


def test_special_tokens_of_any_shape(spark, tmp_path):
    own = Tokenizer.from_file(PATH)
    own.add_special_tokens([AddedToken("[END]", special=True)])
    own.save(f"{tmp_path}/own.json")
    texts = ["a [END] b", "[END]", "no marks", "<|endoftext|>[END]"]
    encoder = bpe.RankArrayBPE(f"{tmp_path}/own.json")
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_rollup_compaction_and_late_commit(spark, monkeypatch):
    """A batch committed while a compaction runs is counted once, and folded batches are still known."""
    rollup = token_rollup.Rollup(spark, Scratch(spark, "roll").folder("t"))
    change = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "t", n, None)], change)
    rollup.commit("b1", batch(1))
    summed = rollup._sum

    def late(base, deltas):
        token_rollup.Rollup(spark, rollup.path).commit("late", batch(100))
        return summed(base, deltas)

    monkeypatch.setattr(rollup, "_sum", late)
    rollup.compact()
    monkeypatch.undo()
    total = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()]
    assert total() == [(2, 101)]
    before = rollup.totals()
    rollup.compact()
    assert [(r.n_docs, r.n_tokens) for r in before.collect()] == total() == [(2, 101)]  # a reader from before
    rollup.compact()
    assert total() == [(2, 101)] and not rollup.commit("b1", batch(1)) and not rollup.commit("late", batch(100))
    assert rollup.commit("b2", batch(5)) and total() == [(3, 106)]
