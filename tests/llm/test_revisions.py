"""The registered query op7_token_rollup covers revised counts and compaction over the whole table."""

from __future__ import annotations

import re
from collections import Counter

from beaconlake.llm import registry, token_rollup
from tests.llm import brute


def test_registered_rollup(spark, docs, rows, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    calls: list = []
    commit, compact, totals = token_rollup.Rollup.commit, token_rollup.Rollup.compact, []

    def seen_commit(self, batch_id, changes):
        ops = Counter(r.op for r in changes.select("op").collect())
        done = commit(self, batch_id, changes)
        calls.append((batch_id, dict(ops), done))
        return done

    def seen_compact(self):
        before = {tuple(r) for r in self.totals().collect()}
        compact(self)
        totals.append((before, {tuple(r) for r in self.totals().collect()}))

    monkeypatch.setattr(token_rollup.Rollup, "commit", seen_commit)
    monkeypatch.setattr(token_rollup.Rollup, "compact", seen_compact)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in registry.queries()["op7_token_rollup"](spark, str(tmp_path)).collect()}

    assert [ops for _, ops, done in calls if done and "revise" in ops] == [{"revise": len(rows)}]
    assert {b for b, _, done in calls if done} == {b for b, _, done in calls if not done}  # all delivered again, none applied
    assert len(totals) == 2 and all(before == after for before, after in totals)
    assert totals[0][1] != totals[1][1]  # the revision changed counts

    first: dict[str, int] = {}
    for k, t, _ in rows:
        first[t or ""] = min(first.get(t or "", k), k)
    want: Counter = Counter()
    for k, t, source in rows:
        if first[t or ""] == k:
            for version, n in (("words@1", len(brute.WORD.findall(t or ""))), ("words@2", len(re.findall(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]", t or "")))):
                want[source, "en", version, "docs"] += 1
                want[source, "en", version, "tokens"] += n
    assert got == {k[:3]: (n, want[*k[:3], "tokens"]) for k, n in want.items() if k[3] == "docs"}
