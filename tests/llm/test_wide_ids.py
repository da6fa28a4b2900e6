"""Record files whose ids do not fit 16 bits."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import Whitespace

from beaconlake.llm import records
from beaconlake.llm.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def wide_vocabulary(tmp_path_factory):
    own = Tokenizer(WordLevel({"[UNK]": 0, "a": 1, "b": 70_000}, unk_token="[UNK]"))
    own.pre_tokenizer = Whitespace()
    path = str(tmp_path_factory.mktemp("vocabulary") / "wide.json")
    own.save(path)
    return path


@pytest.mark.parametrize("wide_end", [True, False])
def test_width_is_chosen(spark, wide_vocabulary, wide_end):
    table = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "doc_id bigint, text string")
    path, end = (PATH, 70_001) if wide_end else (wide_vocabulary, 2)
    folder = Scratch(spark, "wide").path
    assert all(m.wide for m in records.write_records(table, folder, path, end_id=end).collect())
    got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_records(spark, folder).collect()}
    assert all(ids[-1] == end for ids in got.values())
    if not wide_end:
        assert got == {1: [70_000, 2], 2: [1, 2], 3: [2]}
    with pytest.raises(Exception, match="does not fit 16 bits"):
        records.write_records(table, Scratch(spark, "narrow").path, path, end_id=end, wide=False)


def test_narrow_stays_narrow(spark):
    table = spark.createDataFrame([(1, "b")], "doc_id bigint, text string")
    assert not any(m.wide for m in records.write_records(table, Scratch(spark, "narrow").path, PATH, end_id=2).collect())
