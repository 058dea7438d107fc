"""One local session for all tests, and a compare of query results with their SQL."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracewright.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session("8", **{"spark.sql.warehouse.dir": str(shared / "warehouse"), "spark.checkpoint.dir": f"file://{shared}/checkpoints"})
    yield session
    session.stop()


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "null" if math.isnan(x) else f"{x:.6g}" if isinstance(v, float) else str(v)


def rows_of(frame) -> list[tuple[str, ...]]:
    """Rows of a pandas frame in a form that Spark's and DuckDB's results share, columns by name."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture
def agree():
    """agree(df, sql, folder): the rows of a DataFrame are those of SQL over a folder of tables."""
    import duckdb

    def check(df, sql: str, folder) -> int:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for f in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
        got, want = df.toPandas(), con.execute(sql).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows_of(got), rows_of(want)
        for x, y in zip(a, b, strict=False):
            if x != y:  # the last digit may fall either way
                for p, q in zip(x, y, strict=True):
                    assert p == q or math.isclose(float(p), float(q), rel_tol=2e-5), (x, y)
        assert len(a) == len(b)
        return len(a)

    return check
