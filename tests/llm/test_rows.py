"""Operators on single documents, shards, mixes and rollups."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconlake.llm import bpe, mixing, quality, records, shards, substring, token_rollup
from beaconlake.llm.scratch import Scratch
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def bag(rows) -> Counter:
    return Counter(map(tuple, rows))


def test_bpe(docs, rows, library):
    got = bag(bpe.token_digests(docs, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = Counter()
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_bpe_words_and_round_trip(library):
    own = bpe.load(PATH)
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aAeé \n\t1'.,!中\U0001f600"), size=int(n))) for n in rng.integers(0, 400, 200)] + ["ab" * 5000, "'s'll it's", "<|endoftext|><|endoftext|>x", " " * 300, "\x00\x01"]
    for text, packed in zip(texts, own.memo.encode_all(texts)):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(packed) == text


def test_bpe_columns(docs, no_docs):
    out = bpe.decode_ids(bpe.encode_texts(docs, PATH, ids="label"), PATH, ids="label", text="key")
    assert set(out.columns) == set(docs.columns)
    assert out.filter("NOT (coalesce(text, '') <=> key)").count() == 0
    assert bpe.token_digests(no_docs, PATH).count() == 0


def test_records(spark, docs, rows, library):
    got = bag(r[:4] for r in records.op2_records(docs, PATH).collect())
    want, start = Counter(), 0
    for k, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
        start += len(ids)
    assert got == want


def test_record_files(spark, docs, null_docs, no_docs):
    folder = Scratch(spark, "rec").path
    manifest = records.write_records(docs, folder, PATH, end_id=2).collect()
    found = {(r.shard, r.ordinal): r for r in records.read_records(spark, folder).collect()}
    for m in manifest:
        chosen = [m.records - 1, 0]
        for i, ids in zip(chosen, records.read_at(folder, m.name, chosen)):
            assert ids.astype("<u4").tobytes() == found[m.shard, i].ids
    local = folder.removeprefix("file://") + f"/{manifest[0].name}.rec"
    raw = bytearray(open(local, "rb").read())
    raw[20] ^= 1
    open(local, "wb").write(raw)
    with pytest.raises(Exception, match="checksum mismatch"):
        records.read_records(spark, folder).collect()
    assert sorted(((r.doc_id is None), r.n_tokens) for r in records.op2_records(null_docs, PATH).collect())[0][0] is False
    assert records.op2_records(null_docs, PATH).count() == 4
    assert records.op2_records(no_docs, PATH).count() == 0


def test_masked_checksum():
    """Known values of CRC-32C: 32 zero bytes and '123456789'."""
    unmask = lambda v: (((int(v) - 0xA282EAD8) & 0xFFFFFFFF) >> 17 | ((int(v) - 0xA282EAD8) & 0xFFFFFFFF) << 15) & 0xFFFFFFFF
    got = records.masked_crc32c([b"\0" * 32, b"123456789", b"", b"\0" * 3000])
    assert unmask(got[0]) == 0x8A9136AA and unmask(got[1]) == 0xE3069283 and unmask(got[2]) == 0


def test_quality(docs, rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    for options in ({}, {"min_docs": 3, "share": 0.0}, {"min_docs": 1, "share": 0.02, "max_lost": 0.1}):
        full = {"min_docs": quality.MIN_DOCS, "share": quality.SHARE, "max_lost": quality.MAX_LOST} | options
        want = brute.quality(rows, **full)
        got = quality.judge(docs, **options)
        assert bag(got.select(*names).collect()) == bag([[w[n] for n in names] for w in want])
        texts = Counter()
        for (k, t, _), w in zip(rows, want):
            if w["kept"]:
                texts[k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in w["lost_lines"])] += 1
        cleaned = quality.clean(docs, **options)
        assert cleaned.columns == docs.columns
        assert bag(cleaned.select("doc_id", "text").collect()) == texts


def test_quality_boilerplate(spark):
    """A footer of one host goes; the same line on another host, where it is rare, stays; a page of footers is rejected."""
    body = lambda i: " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}x{j}" for j in range(80))  # noqa: E731  (digits are normalised, letters tell bodies apart)
    rows = [(i, f"{body(i)}\nAll rights reserved {i:02}", "a") for i in range(40)] + [(100 + i, f"{body(100 + i)}\nAll rights reserved 07", "b") for i in range(2)]
    rows.append((200, "\n".join(f"All rights reserved {j:02}" for j in range(20)) + "\n" + " ".join(f"q{j}" for j in range(30)), "a"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in quality.clean(table).collect()}
    assert got == {i: body(i) for i in range(40)} | {k: t for k, t, s in rows if s == "b"}


def test_quality_edges(null_docs, no_docs):
    assert {(r.doc_id, r.kept) for r in quality.op4_quality(null_docs).collect()} == {(None, False), (1, False)}
    assert quality.op4_quality(no_docs).count() == 0 and quality.clean(no_docs).count() == 0


def test_substring(spark, docs, rows):
    extra = "This passage of many words appears in two documents, at different places. "
    more = spark.createDataFrame([(5000, "Some lead in words here. " + extra, "en", "z", 1), (5001, extra + "And then a tail of text follows on behind it all.", "en", "z", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    everything = [(k, t) for k, t, _ in rows] + [(r.doc_id, r.text) for r in more.collect()]
    held = defaultdict(list)
    for k, t in everything:
        for start, end, digest in brute.sentences(t or ""):
            held[digest].append((k, start, end))
    want = Counter()
    for places in held.values():
        first = min(places)
        for k, start, end in places:
            if (k, start) != first[:2]:
                want[k, start, end, first[0], first[1]] += 1
    got = substring.op5_substring(table)
    assert bag(got.select("doc_id", "start_char", "end_char", "kept_doc_id", "kept_start_char").collect()) == want
    spans = substring.repeated_spans(table)
    cut = {r.doc_id: r.text for r in substring.remove_spans(table, spans).select("doc_id", "text").collect()}
    for k, t in everything:
        if t is not None:
            gone = {i for kk, s, e, _, _ in want if kk == k for i in range(s, e)}
            assert cut[k] == "".join(c for i, c in enumerate(t) if i not in gone)


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
def test_substring_edges(null_docs, no_docs, unit):
    assert {(r.doc_id, r.kept_key) for r in substring.repeated_spans(null_docs, unit=unit, min_words=3).collect()} == {(1, None)}
    assert substring.repeated_spans(no_docs, unit=unit).count() == 0


def test_shards(spark, docs, rows, null_docs, no_docs, sf):
    for table in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        source = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = shards.op8_shards(table).collect()
        size = lambda t: len((t or "").encode()) + 16
        assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((k, size(t), zlib.crc32((t or "").encode())) for k, t in source)
        slots = defaultdict(list)
        total = Counter()
        for r in got:
            slots[r.shard].append(r.slot)
            total[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
        most = max(size(t) for _, t in source)
        assert max(total.values()) <= sum(total.values()) / 40 + most + 16
    assert shards.op8_shards(null_docs).count() == 4
    assert shards.op8_shards(no_docs).count() == 0


def test_shards_even(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(k), int(w)) for i, (k, w) in enumerate(zip(rng.integers(0, 10**9, 6000), rng.integers(100, 400, 6000)))]
    rows += [(10000 + i, 77, 200) for i in range(3000)]  # a third of all rows has one key
    table = spark.createDataFrame(rows, "id bigint, k bigint, w bigint").withColumn("slot", F.lit("old")).repartition(7)
    out = shards.assign_shards(table, 16, key="k", size="w", tie="id")
    total = {r.shard: r.w for r in out.groupBy("shard").agg(F.sum("w").alias("w")).collect()}
    fair = sum(total.values()) / 16
    assert len(total) == 16 and max(total.values()) < 1.03 * fair and min(total.values()) > 0.97 * fair
    spans = sorted((r.lo, r.hi) for r in out.filter("k > 10000000").groupBy("shard").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # beyond the subdivided range
    again = shards.assign_shards(table.repartition(3), 16, key="k", size="w", tie="id")
    assert bag(out.select("id", "shard", "slot").collect()) == bag(again.select("id", "shard", "slot").collect())


def test_mixing(docs, rows, null_docs, no_docs):
    got = mixing.op9_mixing(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    target = brute.targets(dict(sizes))
    by_doc = defaultdict(set)
    for k, t, s in rows:
        by_doc[k].add((len(brute.WORD.findall(t or "")), sizes[s], float(target[s])))
    taken, largest = Counter(), Counter()
    source = {k: s for k, _, s in rows}
    for r in got:
        assert any((r.size, r.source_size) == (a, b) and abs(r.target - c) <= 1e-6 * max(1, c) for a, b, c in by_doc[r.doc_id])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] + 1 for s in sizes)
    assert bag(got) == bag(mixing.op9_mixing(docs.repartition(2)).collect())
    plan = {r.doc_id: r.copies for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    repeated = {k for k, n in Counter(k for k, _, _ in rows).items() if n > 1}
    assert all(count[k] == n for k, n in plan.items() if k not in repeated)
    assert mixing.op9_mixing(null_docs).count() == 4 and mixing.op9_mixing(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 300}, {"a": 0}, {"a": 0, "b": 7}, {None: 50, "": 3, "z": 900, "é": 20, "y": 1, "x": 2, "w": 3}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n_docs bigint")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_rollup(spark):
    rollup = token_rollup.Rollup(spark, Scratch(spark, "roll").folder("t"))
    change = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
    make = lambda rows: spark.createDataFrame(rows, change)
    totals = lambda: {tuple(r) for r in rollup.totals().collect()}
    assert totals() == set()
    first = make([("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, "en", "t1", 7, None), ("insert", "b", None, "t2", None, None)])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert totals() == {("a", "en", "t1", 2, 15), (None, "en", "t1", 1, 7), ("b", None, "t2", 1, 0)}
    rollup.compact()
    assert not rollup.commit("b1", first)
    assert rollup.commit("b2", make([("delete", "a", "en", "t1", 5, None), ("revise", "a", "en", "t1", 12, 10), ("delete", None, "en", "t1", 7, None)]))
    assert totals() == {("a", "en", "t1", 1, 12), ("b", None, "t2", 1, 0)}
    rollup.compact()
    assert totals() == {("a", "en", "t1", 1, 12), ("b", None, "t2", 1, 0)}
    assert rollup.commit("empty", make([])) and totals() == {("a", "en", "t1", 1, 12), ("b", None, "t2", 1, 0)}
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", make([("drop", "a", "en", "t1", 5, None)]))
    assert totals() == {("a", "en", "t1", 1, 12), ("b", None, "t2", 1, 0)}
    with pytest.raises(ValueError):
        rollup.commit("../up", first)


def test_rollup_edges(null_docs, no_docs):
    got = {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.op7_token_rollup(null_docs).collect()}
    assert sum(n for n, _ in got.values()) == 8  # under two versions; without a key no row is a copy
    assert token_rollup.op7_token_rollup(no_docs).count() == 0
