"""The memo of chunks: the ids of whole texts, each distinct chunk encoded once and many in a run."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import Whitespace

from beaconlake.llm import chunks, records

ODD = ["<|endoftext|>", " <|endoftext|> a", "a\n b", "a  b  c", "a  b", "Ġ Ġx y", " ", "x ", "é　 b c\r d", "w\t e", "a'll 'll 've", "\U0001f600 ́combining", None, "", "a <|endoftext|>b c<|endoftext|> d", "one two three two one", "\n x", "x\n\n y"]


@pytest.mark.parametrize("bounds", [(1 << 22, 500_000), (40, 3)])
@pytest.mark.parametrize("wide", [False, True])
def test_ids_of_whole_texts(monkeypatch, tmp_path, bounds, wide):
    monkeypatch.setattr(chunks, "GROUP_CHARS", bounds[0])
    monkeypatch.setattr(chunks, "MEMO_ENTRIES", bounds[1])
    path = public_tokenizers.path("byte_bpe_50k.json")
    if wide:  # a vocabulary without spaces in its tokens
        own = Tokenizer(WordLevel({"[UNK]": 0, "a": 1, "two": 70_000}, unk_token="[UNK]"))
        own.pre_tokenizer = Whitespace()
        own.save(path := str(tmp_path / "wide.json"))
    tokenizer = records.LibraryTokenizer(path)
    want = [tokenizer._encode([t or ""])[0] for t in ODD]
    for _ in range(2):
        assert list(tokenizer.memo.encode_all(ODD * 3)) == want * 3


def test_chunks_are_encoded_in_runs():
    tokenizer = records.LibraryTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    library, calls = tokenizer.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    tokenizer.tokenizer = Counted()
    texts = [" ".join(f"w{i % 500}x" for i in range(k, k + 300)) for k in range(0, 900, 100)]
    list(tokenizer.memo.encode_all(texts))
    assert sum(calls) <= 30  # 500 distinct chunks in runs, and the heads
