"""What no query does is claimed by none and named as left out."""

from __future__ import annotations

from pathlib import Path

from beaconlake.plans.registry import QUERIES

NOT_BUILT = {"S18"}


def test_not_built_is_not_claimed():
    assert not {(name, i) for name, q in QUERIES.items() for i in q.covers if i in NOT_BUILT}
    readme = (Path(__file__).parent.parent / "README.md").read_text()
    assert all(f"({i})" in readme for i in NOT_BUILT)
