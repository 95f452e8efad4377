"""Every query with SQL equals DuckDB's answer on the smallest tables, apart from those covered by their own tests."""

import glob
import os

import duckdb
import pytest

from compare import table
from sunlattice.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    res = con.execute(catalogue.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in res.description], res.fetchall())


def test_stream_scores_like_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from sunlattice.plans import pipeline
    from sunlattice.streaming import requests

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"site_id":1,"lat":10.0,"lon":20.0,"power_kw":5.0}\n{"site_id":2,"lat":99.0,"lon":0.0,"power_kw":5.0}\n')
    stream = requests.request_stream(spark, f"file://{tmp_path}/in")
    vectors = pipeline.feature_vectors(spark, SF)
    query = requests.responses(stream, vectors, F.lit(0.2)).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.site_id, r.cf_category) for r in spark.table("scored").collect()] == [(1, "medium")]
