from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantsieve.functions.metrics import with_metrics
from quantsieve.operators import ranking
from quantsieve.operators.scoring import scored_universe
from quantsieve.sources import tables
from quantsieve.sources.schema import HEADERS
from quantsieve.sources.universe import read_panel
from quantsieve.streaming import refresh as streaming
from quantsieve.streaming.refresh import refresh, refresh_uploads


@pytest.mark.parametrize("indexed", [False, True])
def test_refresh_rescores_touched_snapshots(spark, sf_dir, tmp_path, indexed, monkeypatch):
    monkeypatch.setattr(ranking, "LEAST_RANGES", 2)
    panel = read_panel(spark, sf_dir, ["2000-08-01", "2001-08-01"]).withColumn("_row_id", F.concat_ws("@", "as_of", "_row_id")).cache()
    schema = ", ".join(f"`{c}` {t}" for c, t in panel.dtypes)
    paths = [str(tmp_path / p) for p in ("in", "raw", "scored", "checkpoint")]
    late = (F.col("as_of") == F.lit("2001-08-01").cast("date")) & (F.crc32("ticker") % 2 == 0)
    for part in (panel.where(~late), panel.where(late)):
        part.write.mode("append").parquet(paths[0])
        refresh(spark, paths[0], schema, *paths[1:], index_path=str(tmp_path / "index") if indexed else None).awaitTermination()
    got = {r["_row_id"]: r["overall_score"] for r in tables.load(spark, paths[2]).collect()}
    want = {r["_row_id"]: r["overall_score"] for r in scored_universe(with_metrics(panel), universe_keys=["as_of"]).collect()}
    assert got == want


def upload(path, columns, tickers):
    path.parent.mkdir(parents=True, exist_ok=True)
    value = lambda c, t, i: {"Ticker": t, "Name": "N", "Sector": "S", "Industry": "I"}.get(c, str(1 + (hash_of(c) + i * i) % 97))
    path.write_text("\n".join([",".join(f'"{c}"' for c in columns), *[",".join(f'"{value(c, t, i)}"' for c in columns) for i, t in enumerate(tickers)]]) + "\n")


def hash_of(c):
    return sum(map(ord, c))


def test_uploads_are_taken_up_and_bad_ones_set_apart(spark, tmp_path):
    heads, drop = list(HEADERS), tmp_path / "in"
    paths = [str(tmp_path / p) for p in ("in", "raw", "scored", "quarantine", "checkpoint")]
    run = lambda: refresh_uploads(spark, *paths).awaitTermination()
    seen = lambda: {(str(r["as_of"]), r["ticker"]): r["overall_score"] for r in tables.load(spark, paths[2]).collect()}
    upload(drop / "2001-08-01.csv", heads, ["A", "B", "C"])
    upload(drop / "sub" / "2001-02-01 more+1.CSV", [*heads[::-1], "Extra"], ["A", "D"])
    upload(drop / "2001-08-01-bad.csv", heads[2:], ["X"])
    upload(drop / "undated.csv", heads, ["Y"])
    (drop / "2001-08-01.txt").write_text("no table")
    (drop / "2001-08-01-empty.csv").write_text("\n")
    run()
    assert set(seen()) == {("2001-08-01", t) for t in "ABC"} | {("2001-02-01", t) for t in "AD"}
    found = tables.load(spark, paths[3]).collect()
    name = lambda r: r["file"].rsplit("/", 1)[-1]
    assert {(name(r), r["finding"], r["subject"]) for r in found if name(r) != "2001-08-01-empty.csv"} == {("2001-08-01-bad.csv", "missing_column", heads[0]), ("2001-08-01-bad.csv", "missing_column", heads[1]), ("undated.csv", "no_date", ""), ("2001-08-01.txt", "unsupported", "")}
    assert sum(name(r) == "2001-08-01-empty.csv" for r in found) == len(heads)
    # A later wave moves its own snapshot's scores and no others.
    before, folders = seen(), tables.partitions(spark, paths[2])
    upload(drop / "2001-08-01-late.csv", heads, ["E", "F", "G", "H"])
    run()
    after, now = seen(), tables.partitions(spark, paths[2])
    assert set(after) == set(before) | {("2001-08-01", t) for t in "EFGH"}
    assert folders["as_of=2001-02-01"] == now["as_of=2001-02-01"] and folders["as_of=2001-08-01"] != now["as_of=2001-08-01"]
    rows = tables.load(spark, paths[1])
    want = scored_universe(with_metrics(rows), universe_keys=["as_of"])
    assert {(str(r["as_of"]), r["ticker"]): r["overall_score"] for r in want.collect()} == after
    assert rows.select("_row_id").distinct().count() == 9 and "Extra" in rows.columns
    run()  # nothing new
    assert tables.partitions(spark, paths[2]) == now


def test_a_batch_that_fails_is_taken_up_again_once(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / p) for p in ("in", "raw", "scored", "quarantine", "checkpoint")]
    upload(tmp_path / "in" / "2001-08-01.csv", list(HEADERS), ["A", "B"])
    monkeypatch.setattr(streaming, "rescore", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        refresh_uploads(spark, *paths).awaitTermination()
    assert tables.load(spark, paths[2]) is None
    monkeypatch.undo()
    refresh_uploads(spark, *paths).awaitTermination()
    assert tables.load(spark, paths[1]).count() == tables.load(spark, paths[2]).count() == 2
