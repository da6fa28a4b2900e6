"""The registered query op5_substring: lines, paragraphs and sentences together."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from beaconlake.llm import registry, substring
from tests.llm import brute

SHORT = "Menu - Home"
CHOPPED = "Go on. Stop here. Do not wait. We are there. It is late. They know it. Come in now."
MORE = [
    (5000, f"{SHORT}\nFirst of its kind.\n{CHOPPED}\n\nA paragraph\nover two lines\n\n\nüñí end"),
    (5001, f"Lead in words.\n{SHORT.upper()} \n{CHOPPED}"),
    (5002, f"{SHORT}\n\nA paragraph over\ntwo lines\n\n{SHORT}\n"),
    (5003, f"Before. The river rose over both of its banks again last night. After.\n{SHORT}"),
    (5004, "Other. The river rose over both of its banks again last night. Words."),
]


def spans(text: str) -> set[tuple[int, int, str]]:
    """(start, end, words joined) of each line, paragraph and sentence of at least 8 words."""
    out = set(brute.sentences(text))
    for edge in (r"\n", r"\n\n+"):
        at = 0
        for m in [*re.finditer(edge, text), None]:
            found = list(brute.WORD.finditer(text, at, m.start() if m else len(text)))
            if found:
                out.add((found[0].start(), found[-1].end(), " ".join(brute.lower(w[0]) for w in found)))
            at = m.end() if m else 0
    return out


@pytest.fixture(scope="module")
def table(spark, docs, tmp_path_factory):
    where = tmp_path_factory.mktemp("passages")
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(MORE, "doc_id bigint, text string")).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_registered_passages(spark, table, rows):
    texts = [(k, t or "") for k, t, _ in rows] + MORE
    held = defaultdict(set)
    for k, t in texts:
        for start, end, words in spans(t):
            held[words].add((k, start, end))
    gone = defaultdict(dict)
    for words, places in held.items():
        first = min(places)
        for k, start, end in places:
            if (k, start) != first[:2]:
                gone[k][start, end] = (len(words.split(" ")), *first[:2])
    want = Counter((k, *span, *kept) for k, own in gone.items() for span, kept in own.items() if not any(o != span and o[0] <= span[0] and span[1] <= o[1] for o in own))
    got = registry.queries()["op5_substring"](spark, table)
    assert Counter(map(tuple, got.collect())) == want
    assert len({k for k, *_ in want if k >= 5000}) == 4

    cut = {r.doc_id: r.text for r in substring.remove_spans(spark.read.parquet(f"{table}/documents.parquet"), substring.repeated_passages(spark.read.parquet(f"{table}/documents.parquet"))).collect()}
    for k, t in texts:
        lost = {i for kk, s, e, *_ in want if kk == k for i in range(s, e)}
        assert (cut[k] or "") == "".join(c for i, c in enumerate(t) if i not in lost)
    assert cut[5001] == "Lead in words.\n \n"
    assert cut[5002] == "\n\n\n\n\n"
    assert cut[5004] == "Other.  Words."


def test_passages_edges(null_docs, no_docs):
    assert [(r.doc_id, r.kept_doc_id) for r in substring.op5_passages(null_docs).collect()] == [(1, None)]
    assert substring.op5_passages(no_docs).count() == 0
