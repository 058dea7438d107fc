"""Windows over files that arrive in no order of time."""

from __future__ import annotations

from tests.conftest import TESTDATA
from tracewright import plans

SQL = plans.oracle_sql()["q_stream_windows"]


def test_late_files_are_counted(spark, agree, tmp_path):
    events = spark.read.parquet(str(TESTDATA / "sf0.001" / "events.parquet"))
    thirds = events.selectExpr("*", "ntile(3) over (order by ts desc) as k")
    for k in (1, 2, 3):  # the last days arrive first
        thirds.where(f"k = {k}").drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    df = plans.queries()["q_stream_windows"](spark, str(tmp_path))
    assert df.agg({"n": "sum"}).first()[0] == events.count()
    agree(df, SQL, tmp_path)
