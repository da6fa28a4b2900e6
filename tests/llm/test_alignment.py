"""Alignment of two tokenizers against plain Python and the two libraries."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from beaconlake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "a▁b", "<s> <unk> <0x41> <|endoftext|>", "x <|endoftext|>\n\n  y", " lead", "trail ", "a\x00b", "\r\n\r\n\t z", "　ﬁé é", "\U0001f600\U0001f468‍\U0001f469 ok", "don't it's 1234567 the  the"]


def alphabet() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    """The contract, document by document."""

    def __init__(self):
        self.a, self.b, self.byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alphabet()
        self.a.encode_special_tokens = True

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == b"".join(t for _, t in b) == want else ([], [])

    @staticmethod
    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def align(self, text):
        a, b = map(self.spans, self.tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) * len(b) < 4_000_000 else self.swept(a, b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, at = [], 0
        ia = ib = 0
        for cut in cuts:
            own = [[], []]
            while ia < len(a) and a[ia][2] <= cut:
                own[0].append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= cut:
                own[1].append(str(b[ib][0]))
                ib += 1
            groups.append("|".join(map(",".join, own)))
            at = cut
        return len(a), len(b), links, groups

    @staticmethod
    def swept(a, b):
        out, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                out.append((i, b[k][0]))
                k += 1
        return out


def expected(rows):
    plain, memo = Plain(), {}
    for _, text in rows:
        if text not in memo:
            memo[text] = plain.align(text)
    made = [(k, memo[t]) for k, t in rows]
    count = Counter(link for _, m in made for link in m[2])
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for k, (n_a, n_b, links, groups) in made:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((k, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out, count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(rows, key=repr)


def test_against_plain_python(spark, docs, rows):
    want, count = expected([(r[0], r[1]) for r in rows])
    made, pairs = alignment.align(docs, A, B)
    assert made.columns == COLUMNS
    assert order(tuple(r) for r in made.collect()) == order(want)
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.links for r in pairs.collect()} == count


@pytest.mark.parametrize("block_links", [1, 50])
def test_odd_texts_in_small_blocks(spark, block_links):
    """Blocks of one document or few: the same totals."""
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD * 2 + ["one two three four " * 30])]
    want, _ = expected(rows)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    assert order(tuple(r) for r in alignment.align(table, A, B, block_links=block_links)[0].collect()) == order(want)


def test_parts_and_slices(monkeypatch):
    """A text in parts, slices of one part: the same groups and links as whole."""
    texts = [t for t in ODD] + ["the quick  brown fox, jumps over\tthe 12 lazy dogs' " * 40, "x" * 500]
    whole = alignment.load(A, B)
    want = [(b";".join(t.groups), t.counts.tolist(), p.tolist()) if t else None for _, t, p in alignment._read(whole, texts, True)]
    monkeypatch.setattr(alignment, "PART_CHARS", 10)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 30)
    got = [(b";".join(t.groups), t.counts.tolist(), p.tolist()) if t else None for _, t, p in alignment._read(alignment.Aligner(A, B), texts, True)]
    assert got == want


def test_groups_column(spark):
    texts = [(1, "hello world", "old"), (2, None, "old"), (3, "a▁b", None)]
    got = alignment.token_groups(spark.createDataFrame(texts, "doc_id int, text string, groups string"), A, B).collect()
    plain = Plain()
    assert [r.groups for r in sorted(got)] == [";".join(plain.align(t)[3]) for _, t, _ in texts]


def test_null_keys_and_no_rows(spark, null_docs, no_docs):
    assert alignment.op11_alignment(no_docs, A, B).collect() == []
    want, _ = expected([(r.doc_id, r.text) for r in null_docs.collect()])
    assert order(tuple(r) for r in alignment.op11_alignment(null_docs, A, B).collect()) == order(want)
