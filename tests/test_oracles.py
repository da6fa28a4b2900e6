"""Every query with SQL agrees with DuckDB; every query runs; nothing outside llm needs llm."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from beaconlake.plans.registry import QUERIES

ROOT = Path(__file__).resolve().parents[1]


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(map(norm, v.values()))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    query = QUERIES[name]
    df = query.build(spark, sf)
    rows = df.collect()
    if query.sql:
        found = duck.execute(query.sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        want = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
        assert sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr) == want


def test_nothing_else_imports_llm():
    users = [p for p in (ROOT / "beaconlake").rglob("*.py") if "llm" not in p.parts and "beaconlake.llm" in p.read_text()]
    assert users == []


def test_entry_without_llm(tmp_path):
    """The entry module still serves the other queries where the subpackage is gone."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    package = tmp_path / "beaconlake"
    package.mkdir()
    for p in (ROOT / "beaconlake").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ranked_groups' in q and not any(__import__('re').match('op[0-9]+_|pipeline$', n) for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
