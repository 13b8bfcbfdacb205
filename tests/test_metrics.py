from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantsieve.functions.metrics import METRICS, with_metrics
from quantsieve.functions.numeric import parse_number
from tests.fixture_rows import COMPANIES, GOLDEN, STEADY


@pytest.fixture(scope="module")
def computed(spark):
    raw = [(i, *company.values()) for i, company in enumerate(COMPANIES)]
    df = spark.createDataFrame(raw, "_row_id long, " + ", ".join(f"{c} double" for c in STEADY))
    return [r.asDict() for r in with_metrics(df).orderBy("_row_id").collect()]


def test_registry_has_all():
    assert len(METRICS) == 39 and set(METRICS) == set(GOLDEN)


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden(computed, name):
    for row, want in zip(computed, GOLDEN[name], strict=True):
        assert row[name] == (None if want is None else pytest.approx(want, abs=1e-8)), name


def test_all_missing(spark):
    df = spark.createDataFrame([(i, *[None] * len(STEADY)) for i in range(3)], "_row_id long, " + ", ".join(f"{c} double" for c in STEADY))
    for r in with_metrics(df).select(*METRICS).collect():
        assert all(v is None for v in r)


def test_infinity_never_becomes_nan(spark):
    df = spark.createDataFrame([(float("inf"), float("inf"))], "fcf_yield double, fcf_yield_3yr_avg double")
    for c in STEADY:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    assert with_metrics(df).first()["fcf_yield_diff"] is None


def test_neutral_mscore(spark):
    from quantsieve.functions.metrics import mscore

    parts = ["dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi"]
    df = spark.createDataFrame([(*[1.0] * 7, 0.0), (None, *[1.0] * 6, 0.0)], ", ".join(f"{p} double" for p in parts) + ", tata double")
    got = [r[0] for r in df.select(mscore()).collect()]
    assert got[0] == pytest.approx(-2.48) and got[1] is None


CELLS = {"1,234.5": 1234.5, " 7": 7.0, "\t7": 7.0, "1e5": 1e5, "+3": 3.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "NaN": None, "nan": None, "#N/A N/A": None, "": None, "abc": None, "5%": None, "$5": None, "True": None, "1_000": None, "0x10": None, "1.5d": None, "1.5f": None, "1,2,3": 123.0}


def test_parse_number(spark):
    df = spark.createDataFrame([(k,) for k in CELLS], "s string")
    assert {r[0]: r[1] for r in df.select("s", parse_number(F.col("s"))).collect()} == CELLS
