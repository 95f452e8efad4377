"""Paged catalogues: what is asked for is pushed down, and other pages stay shut."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunlattice.sources import stac

ZERO = datetime(2021, 1, 1)


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalogue"))
    rows = [(f"s{i:04d}", ZERO + timedelta(hours=7 * i), None if i % 9 == 0 else float(i * 37 % 101), -170 + i * 0.3, -50 + i * 0.1, -169 + i * 0.3, -49 + i * 0.1) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, datetime timestamp_ntz, cloud double, min_lon double, min_lat double, max_lon double, max_lat double")
    assert stac.write_catalogue(df, path, 25, 10) >= 40
    return path, rows


def want(rows, box=None, start=None, end=None, cloud=None):
    return sorted(r[0] for r in rows if (box is None or (r[3] <= box[2] and r[5] >= box[0] and r[4] <= box[3] and r[6] >= box[1])) and (start is None or r[1] >= start) and (end is None or r[1] <= end) and (cloud is None or (r[2] is not None and r[2] <= cloud)))


def test_all_items_and_windows(spark, catalogue):
    path, rows = catalogue
    first = f"file://{path}/index-0.json"
    got = stac.catalogue_pages(spark, first).collect()
    assert sorted(r.id for r in got) == want(rows) and {(r.id, r.cloud) for r in got} == {(r[0], r[2]) for r in rows}
    box, start, end = (-100.0, -60.0, -60.0, -20.0), ZERO + timedelta(days=60), ZERO + timedelta(days=100)
    some = stac.catalogue_pages(spark, first, box, start.isoformat(), end.isoformat(), 40.0)
    assert sorted(r.id for r in some.collect()) == want(rows, box, start, end, 40.0) != []
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    edge = rows[500][1]
    assert [r.id for r in stac.catalogue_pages(spark, first).where(F.col("datetime") == F.lit(edge.isoformat()).cast("timestamp")).collect()] == ["s0500"]
    assert stac.catalogue_pages(spark, first, start="2031-01-01").count() == 0


def test_pages_outside_are_not_opened(spark, catalogue, tmp_path):
    path, rows = catalogue
    for name in os.listdir(path):
        (tmp_path / name).write_bytes(open(f"{path}/{name}", "rb").read())
    end = ZERO + timedelta(days=50)
    index = [json.loads((tmp_path / n).read_text()) for n in os.listdir(tmp_path) if n.startswith("index-") and n.endswith(".json")]
    late = [p["href"] for i in index for p in i["pages"] if p["interval"][0] > end.isoformat() + "Z"]
    for name in late:
        (tmp_path / name).write_text("no JSON")
    assert len(late) > 20
    got = stac.catalogue_pages(spark, f"{tmp_path}/index-0.json", end=end.isoformat())
    assert sorted(r.id for r in got.collect()) == want(rows, end=end) and got.rdd.getNumPartitions() <= 4
    with pytest.raises(Exception, match="items-"):
        stac.catalogue_pages(spark, f"{tmp_path}/index-0.json", tries=1).count()
    told = stac.catalogue_pages(spark, f"{tmp_path}/index-0.json", bad="skip", tries=1, permits=3)
    assert told.where("error is not null").count() == len(late)
    bad = {i for n in late for i in range(int(n[7:11]), int(n[13:17]) + 1)}
    assert sorted(r.id for r in told.where("error is null").collect()) == sorted(r[0] for i, r in enumerate(rows) if i not in bad)
