"""Boilerplate on a host of over 5,000 texts, where the share of texts is the limit."""

from __future__ import annotations

from beaconlake.llm import quality


def test_share_on_a_large_host(spark):
    letters = "abcdefghij"
    name = lambda i: "".join(letters[int(c)] for c in f"{i:04}")  # noqa: E731  (digits are normalised)
    held = {"Footer of twelve": range(0, 12), "Footer of thirteen": range(100, 113), "Footer of a hundred": range(200, 300)}
    rows = []
    for i in range(6000):
        lines = [line for line, places in held.items() if i in places]
        rows.append((i, "\n".join([" ".join(f"{name(i)}{a}{b}" for a in letters for b in letters[:6]), *lines]), "a"))
    rows += [(6000 + i, rows[0][1], "a") for i in range(50)]  # exact copies count once
    lost = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).filter("size(lost_lines) > 0").select("doc_id").collect()}
    assert lost == {*held["Footer of thirteen"], *held["Footer of a hundred"]}
