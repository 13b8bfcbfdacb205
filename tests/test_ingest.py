from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantsieve.plans import queries
from quantsieve.sources import tables, uploads
from quantsieve.sources.schema import HEADERS
from quantsieve.sources.shared import drop_intermediates, hadoop


def write(path, columns, rows):
    path.write_text("\n".join([",".join(f'"{c}"' for c in columns), *[",".join(f'"{v}"' for v in r) for r in rows]]) + "\n")


@pytest.fixture
def folder(tmp_path):
    heads = list(HEADERS)
    put = lambda h, t: {"Ticker": t, "Name": "N", "Sector": "NA", "Industry": "I", "Market Cap ($M)": "1,234.5", "Available LOC": "#N/A N/A", "Cash Balance": "#N/A N/A"}.get(h, " 7")
    write(tmp_path / "a.csv", heads, [[put(h, "AAA") for h in heads]])
    write(tmp_path / "b.CSV", [*heads[::-1], "Extra"], [[*[put(h, "BBB") for h in heads[::-1]], "x"], [*[put(h, "AAA") for h in heads[::-1]], "5"]])
    return tmp_path


def test_files_of_different_order(spark, folder):
    rows = uploads.ingest(spark, str(folder)).orderBy("ticker").collect()
    assert [r["ticker"] for r in rows] == ["AAA", "AAA", "BBB"]
    for r in rows:
        assert (r["market_cap"], r["available_loc"], r["cash_balance"], r["sector"], r["perf_1m"], r["dil_eps_fy2"]) == (1234.5, 0.0, None, "NA", 7.0, 7.0)
    assert sorted(str(r["Extra"]) for r in rows) == ["5.0", "None", "None"]


def test_row_ids_persist(spark, folder, tmp_path):
    df = uploads.ingest_to(spark, str(folder), str(tmp_path / "raw"))
    assert df.select("_row_id").distinct().count() == 3 and "_source_file" in df.columns


def test_missing_column_is_named(spark, tmp_path):
    heads = [h for h in HEADERS if h not in ("CFO", "P/S 3 Yr. Avg.")]
    write(tmp_path / "a.csv", heads, [["1"] * len(heads)])
    with pytest.raises(KeyError, match=r"lacks 2 required columns: P/S 3 Yr\. Avg\., CFO"):
        uploads.ingest(spark, str(tmp_path))


def test_unsupported_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        uploads.list_uploads(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="a.txt"):
        uploads.list_uploads(spark, str(tmp_path))


def test_stage_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.load(spark, path) is None
    tables.save(spark.range(0), path)
    assert tables.load(spark, path) is None
    tables.save(spark.sql("select 1 as a, '2001-01-01' as as_of union all select 2, '2002-01-01'"), path, "as_of")
    tables.save(spark.sql("select 3 as a, '2002-01-01' as as_of"), path, "as_of")
    assert sorted(r["a"] for r in tables.load(spark, path).collect()) == [1, 3]


def test_a_save_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save(spark.sql("select 1L as a, '2001-01-01' as as_of"), path, "as_of")
    old = tables.load(spark, path)
    broken = spark.range(100).selectExpr("if(id = 99, raise_error('lost'), id) as a", "if(id < 50, '2001-01-01', '2002-01-01') as as_of")
    with pytest.raises(Exception, match="lost"):
        tables.save(broken, path, "as_of")
    assert [r["a"] for r in tables.load(spark, path).collect()] == [1]
    # Readers keep the version they began with until it is cleared away.
    tables.save(spark.sql("select 2L as a, '2001-01-01' as as_of"), path, "as_of")
    assert [r["a"] for r in old.collect()] == [1] and [r["a"] for r in tables.load(spark, path).collect()] == [2]
    assert tables.vacuum(spark, path) >= 1 and [r["a"] for r in tables.load(spark, path).collect()] == [2]
    assert tables.vacuum(spark, path) == 0


def test_versions_of_other_width_and_types(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save(spark.sql("select 1 as a, '01' as k"), path, "k")
    tables.save(spark.sql("select 2 as a, 2.5D as more, '02' as k"), path, "k")
    got = {tuple(r) for r in tables.load(spark, path).select("k", "a", "more").collect()}
    assert got == {("01", 1, None), ("02", 2, 2.5)}
    assert tables.save(spark.range(5), str(tmp_path / "u"), observe={"n": F.count(F.lit(1)), "top": F.max("id")}) == {"n": 5, "top": 4}


def test_report_of_missing_columns(spark, tmp_path):
    heads = list(HEADERS)
    write(tmp_path / "a b+é.csv", heads, [["1"] * len(heads)] * 3)
    write(tmp_path / "b.csv", heads[1:], [["1"] * len(heads)] * 2)
    (tmp_path / "c.csv").write_text("")
    rows = uploads.missing_report(spark, uploads.list_uploads(spark, str(tmp_path))).collect()
    assert sorted({(r["file"].rsplit("/", 1)[-1], r["n_lines"]) for r in rows}) == [("b.csv", 3), ("c.csv", 0)]
    assert sum(r["file"].endswith("c.csv") for r in rows) == len(heads) and [r["missing_column"] for r in rows if r["file"].endswith("b.csv")] == [heads[0]]


def test_intermediates_go(spark, tmp_path):
    df = tables.staged(spark.range(3), "x")
    path, fs = hadoop(spark, df.inputFiles()[0])
    assert fs.exists(path) and df.count() == 3
    drop_intermediates(spark)
    assert not fs.exists(path)


def test_an_upload_reads_its_order_lines_once(spark, sf_dir, monkeypatch):
    sent = []
    monkeypatch.setattr(queries, "_send", lambda df, columns, path: sent.append(df) or path)
    queries._upload(spark, sf_dir)
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in sent] == [1, 1]  # the written universe


def test_commas_of_uploads(spark):
    values = [0.5, -12.25, 999.0, 1000.0, -999.5, -1234.5, 123456.78, 999999.0, 1234567.5, -1234567.5, 9999999.0, 1.5e7, 1e-5, 1.25e100, None]
    df = spark.createDataFrame([(2 * i, v) for i, v in enumerate(values)], "_row_id long, available_loc double")
    got = [r[0] for r in queries._messy(df, ["available_loc"]).collect()]
    want = df.select(F.coalesce(F.regexp_replace(F.col("available_loc").cast("string"), r"(?<!\.\d{0,30})(?<=\d)(?=(\d{3})+(?:\.|$))", ","), F.lit("#N/A N/A")))
    assert got == [r[0] for r in want.collect()] and {"1,000.0", "-1,234,567.5"} < set(got)
