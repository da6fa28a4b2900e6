"""All queries of the engine by name."""

from __future__ import annotations

from beaconlake.plans import board, calls, desk, feeds, geocode, joins, live, models, personal, relational, search, text, tracks
from beaconlake.plans.core import Query

QUERIES: dict[str, Query] = {**relational.QUERIES, **joins.QUERIES, **text.QUERIES, **calls.QUERIES, **feeds.QUERIES, **desk.QUERIES, **search.QUERIES, **geocode.QUERIES, **board.QUERIES, **live.QUERIES, **models.QUERIES, **personal.QUERIES, **tracks.QUERIES}
