"""Documents that hold every awkward case, for the tests of the llm operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, n int, _k string, _key int, _gone int, _copies int, _lost int, key string, shard int, slot int, label int, copies int"
N_EXTRA = 12


def words(rng: random.Random, n: int, vocab: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocab)}" + rng.choice(["", "", ",", "."]) for _ in range(n)]


def layout(rng: random.Random, text: list[str]) -> str:
    """Words as lines of 5 to 15 words."""
    out, at = [], 0
    while at < len(text):
        step = rng.randrange(5, 16)
        out.append(" ".join(text[at : at + step]))
        at += step
    return "\n".join(out)


def corpus(seed: int = 3) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): originals, exact copies, near copies, two large groups and the odd cases."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    originals = [words(rng, rng.randrange(60, 200)) for _ in range(30)]
    texts += [layout(rng, t) for t in originals]
    for t in originals[:12]:
        near = list(t)
        for _ in range(rng.choice([1, 2, 4, 9])):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    hot = words(rng, 150)
    for i in range(90):  # a large group of near copies, some of which drift apart
        near = list(hot)
        for _ in range(i % 9):
            near[rng.randrange(len(near))] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    texts += [" ".join(originals[0])] * 40
    texts += [None, "", "   \n\t ", "one", "one two three", "one two three", "a b c d e", "A B C D E", "ünïcödé 文字 テスト " * 20, "same same same " * 40, "# $ % < > & | *\n" * 3, "<|endoftext|> it's 1234 don't stop  now\n\n\nnext", "tab\tsep\x0bvt\x0cff\rcr", " lead", "trail ", "\U0001f600 ́combining", "x" * 3000]
    texts.append(" ".join(words(rng, 40_000, 10**6)))
    sources = ["hub", "web", "code", None, ""]
    rows: list[tuple[int | None, str | None, str | None]] = [(i * 3 % 1009, t, sources[0] if i % 2 else sources[i % 5]) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((2000, rows[7][1], "late"))
    return rows


def frame(spark, rows):
    full = [(k, t, "en", s, len(t or ""), *([None] * N_EXTRA)) for k, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, rows).write.parquet(where)
    return spark.read.parquet(where)


@pytest.fixture(scope="session")
def null_docs(spark):
    """Null keys, repeated and not."""
    return frame(spark, [(None, "a b c d e f g", None), (None, "a b c d e f g", None), (None, None, "s"), (1, "a b c d e f g", "s")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
