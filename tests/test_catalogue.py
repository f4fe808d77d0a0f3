"""Every registered snapshot query against its SQL on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from treeline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, con, name):
    mine = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(mine.columns) == sorted(names)
    want = sorted(([plain(dict(zip(names, r))[c]) for c in sorted(names)] for r in found.fetchall()), key=repr)
    got = sorted(([plain(r[c]) for c in sorted(names)] for r in mine.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_exact_round_trips(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows
    if "ok" in rows[0]:
        assert all(r.ok for r in rows)
    if name == "encode_sizes":
        assert all(r.stored_size == (r.original_size + 2 if r.encoding == "R" else r.stored_size) and r.stored_size <= r.original_size + 2 for r in rows)
    if name == "pack_choose_fd":
        assert all((r.kind == "D") == (r.delta_length is not None and r.delta_length < r.full_length) for r in rows)


def test_nothing_else_imports_the_training_operators(tmp_path):
    top = Path(__file__).resolve().parents[1]
    code = "import sys; sys.path.insert(0, sys.argv[1]); sys.modules['treeline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries()); import treeline.__main__"
    assert subprocess.run([sys.executable, "-c", code, str(top)], cwd=tmp_path).returncode == 0
    for f in (top / "treeline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
