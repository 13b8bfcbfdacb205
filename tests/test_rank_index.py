from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from quantsieve.operators import rank_index, ranking
from quantsieve.sources import tables

COLUMNS = {"fx": "x", "fy": "y", "fz": "z"}


def made(spark, ids, seed):
    """x with ties and a value of a third of all rows, y without, z missing but in late rows."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 0.0, -0.0, float(rng.randint(0, 9)), rng.gauss(0, 1)]), rng.gauss(0, 5), 1.5 if seed > 1 and i % 2 else None) for i in ids]
    return spark.createDataFrame(rows, "_row_id long, x double, y double, z double")


def ranks(df):
    return {(r["_row_id"], r["factor"]): r["p"] for r in df.collect()}


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_late_rows_rank_as_if_there_from_the_start(spark, tmp_path, ranges):
    path, rows = str(tmp_path / "index"), made(spark, range(400), 1)
    rank_index.build(path, rows, COLUMNS, ranges=ranges)
    assert ranks(rank_index.ranks(spark, path)) == ranks(ranking.rank_long(ranking.unpivot(rows, ["_row_id"], COLUMNS), (), "window"))
    for k in (2, 3):
        late = made(spark, range(k * 1000, k * 1000 + 30), k)
        first = rank_index.add(path, late, COLUMNS)
        assert rank_index.add(path, late, COLUMNS) == first  # a batch that is run again replaces itself
        rows = rows.union(late)
        assert ranks(rank_index.ranks(spark, path)) == ranks(ranking.rank_long(ranking.unpivot(rows, ["_row_id"], COLUMNS), (), "window"))
    assert rank_index.add(path, late.limit(0), COLUMNS) == []


def test_other_ranges_are_not_read(spark, tmp_path):
    path, rows = str(tmp_path / "index"), made(spark, range(2000), 1)
    rank_index.build(path, rows, COLUMNS, ranges=20)
    before = tables.partitions(spark, f"{path}/slots")
    late = spark.createDataFrame([(9001, 100.0, 0.01, None), (9002, 101.0, 0.02, None)], rows.schema)
    # Slots that no late value falls in are taken away: whoever reads them fails.
    cuts = {r["factor"]: r["_cuts"] for r in tables.load(spark, f"{path}/cuts").collect()}
    assert all(len(c) == 19 for f, c in cuts.items() if f != "fz")
    hit = {(r["slot"]) for r in rank_index._slots(spark, path, late, COLUMNS, "_row_id").collect()}
    assert 2 <= len(hit) <= 4 < len(before)
    for part, folder in before.items():
        if int(part.partition("=")[2]) not in hit:
            shutil.move(folder.removeprefix("file:"), folder.removeprefix("file:") + ".away")
    assert set(rank_index.add(path, late, COLUMNS)) == hit
    after = tables.partitions(spark, f"{path}/slots")
    assert {p for p in after if after[p] != before.get(p)} == {f"slot={s}" for s in hit}
    for folder in before.values():
        away = folder.removeprefix("file:") + ".away"
        if folder in after.values():
            shutil.move(away, folder.removeprefix("file:"))
    assert ranks(rank_index.ranks(spark, path)) == ranks(ranking.rank_long(ranking.unpivot(rows.union(late), ["_row_id"], COLUMNS), (), "window"))
    assert tables.load(spark, f"{path}/counts").agg(F.sum("n")).first()[0] == rows.select(F.count("x") + F.count("y")).first()[0] + 4
