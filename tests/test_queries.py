"""Every registered query of the catalogue against its SQL, and the entry module without the llm folders."""

import math
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tracewright import catalog

ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_against_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.execute(catalog.ORACLES[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == names
    want = Counter(tuple(plain(row[have.index(c)]) for c in names) for row in rel.fetchall())
    assert got == want


def test_entry_works_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "tracewright"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
