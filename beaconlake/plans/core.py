"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A query over a folder of tables, the inventory rows it covers, and its DuckDB SQL if there is one."""

    build: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None = None
