from __future__ import annotations

from quantsieve.operators.history import dedupe_latest
from quantsieve.operators.quality import schema_changes


def test_schema_changes(spark):
    before = spark.sql("select 1L as a, 'x' as b, 2 as gone")
    after = spark.sql("select 'x' as b, 1.5D as a, true as fresh, 1 as more")
    got = {tuple(r) for r in schema_changes(before, after).collect()}
    assert got == {("type", "a", "bigint", "double"), ("lost", "gone", "int", None), ("added", "fresh", None, "boolean"), ("added", "more", None, "int"), ("column_count", "universe", "3", "4")}
    assert schema_changes(before, before).count() == 0


def test_dedupe_latest(spark):
    df = spark.createDataFrame([("A", 1, 10.0), ("A", 3, 30.0), ("B", 2, 20.0), (None, 4, 1.0), (None, 5, 2.0)], "ticker string, _row_id long, v double")
    got = dedupe_latest(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {("A", 3, 30.0), ("B", 2, 20.0), (None, 5, 2.0)}
    assert dedupe_latest(df.limit(0)).count() == 0
