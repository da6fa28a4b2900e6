"""What relays push: a data source over their outboxes, for batches and streams.

Every machine has a folder of envelopes numbered from 0, each a JSON object {machine, token, items,
health}.  The offset of a stream is the next number of every machine, so an envelope is read once
and in order, whatever arrives when; a number that is missing holds its machine up until it comes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MOST_ITEMS = 200
LEAST_TEXT = 4
#: Fields of an item that are kept, and how long they may be.
LENGTHS = {"src": 40, "city": 60, "text": 4000}
SCHEMAS = {
    "items": "machine string, envelope bigint, place int, seq bigint, src string, city string, text string, at timestamp, clip string",
    "health": "machine string, envelope bigint, id string, status string, report string",
    "refused": "machine string, envelope bigint, why string, items int",
}
_NAME = re.compile(r"(\d+)\.json")
PER_TASK = 64


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _outboxes(path: str) -> dict[str, set[int]]:
    """The numbers of the envelopes of every machine."""
    from pyarrow import fs

    files, root = _files(path)
    found: dict[str, set[int]] = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path.removeprefix(root).strip("/").split("/")
        if len(parts) == 2 and (m := _NAME.fullmatch(parts[1])):
            found.setdefault(parts[0], set()).add(int(m[1]))
    return found


class _Envelopes(InputPartition):
    def __init__(self, machine: str, numbers: list[int]):
        self.machine, self.numbers = machine, numbers


def _instant(value) -> datetime | None:
    try:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class _Reading:
    """How one table is read from envelopes."""

    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"].rstrip("/"), options.get("table", "items")
        self.allowed = frozenset(filter(None, options.get("tokens", "").split(",")))

    def chunks(self, numbers: dict[str, list[int]]) -> list[InputPartition]:
        return [_Envelopes(m, ns[i : i + PER_TASK]) for m, ns in sorted(numbers.items()) for i in range(0, len(ns), PER_TASK)]

    def rows(self, partition: _Envelopes) -> Iterator[tuple]:
        files, root = _files(self.path)
        for n in partition.numbers:
            with files.open_input_stream(f"{root}/{partition.machine}/{n}.json") as f:
                yield from self._rows(partition.machine, n, f.read())

    def _rows(self, machine: str, n: int, raw: bytes) -> Iterator[tuple]:
        try:
            body = json.loads(raw)
        except ValueError:
            body = None
        items, health = ((body.get(k) if isinstance(body.get(k), list) else []) for k in ("items", "health")) if isinstance(body, dict) else ([], [])
        why = self._refused(body, items)
        if why:
            if self.table == "refused":
                yield machine, n, why, len(items)
        elif self.table == "items":
            for place, item in enumerate(items):
                if (row := self._item(item)) is not None:
                    yield machine, n, place, *row
        elif self.table == "health":
            for h in health:
                if isinstance(h, dict):
                    yield machine, n, str(h.get("id", "")), None if h.get("status") is None else str(h["status"]), json.dumps(h, sort_keys=True)

    def _refused(self, body, items: list) -> str | None:
        if not isinstance(body, dict):
            return "not a JSON object"
        if self.allowed and hashlib.sha256(str(body.get("token", "")).encode()).hexdigest() not in self.allowed:
            return "unknown token"
        return "too many items" if len(items) > MOST_ITEMS else None

    @staticmethod
    def _item(item) -> tuple | None:
        if not isinstance(item, dict) or not isinstance(item.get("text"), str) or len(item["text"].strip()) < LEAST_TEXT:
            return None
        said = {k: str(item[k]).strip()[:n] if item.get(k) else None for k, n in LENGTHS.items()}
        seq = item.get("seq")
        return seq if isinstance(seq, int) and not isinstance(seq, bool) else None, said["src"] or "unknown", said["city"], said["text"], _instant(item.get("at")), None if item.get("clip") is None else str(item["clip"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.reading = _Reading(options)

    def partitions(self) -> list[InputPartition]:
        return self.reading.chunks({m: sorted(ns) for m, ns in _outboxes(self.reading.path).items()})

    def read(self, partition):
        return self.reading.rows(partition) if isinstance(partition, _Envelopes) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.reading = _Reading(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for machine, numbers in _outboxes(self.reading.path).items():
            n = 0
            while n in numbers:
                n += 1
            out[machine] = n
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.reading.chunks({m: list(range(start.get(m, 0), n)) for m, n in end.items()})

    def read(self, partition):
        return self.reading.rows(partition)


class RelaySource(DataSource):
    """Format ``relay``: options path, table (items, health or refused) and tokens (SHA-256 of those allowed, by commas; none: all).

    Items without a text of four characters are left out.  An envelope that is no JSON object, has an unknown token
    or more than 200 items gives a row of ``refused`` and nothing else.
    """

    @classmethod
    def name(cls) -> str:
        return "relay"

    def schema(self) -> str | StructType:
        return SCHEMAS[self.options.get("table", "items")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("relay")`` and ``spark.readStream.format("relay")`` known to a session."""
    spark.dataSource.register(RelaySource)
