import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from planlake.session import session

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="session")
def written_plans(spark, sf, tmp_path_factory):
    """The plans that most queries are over, made once and written; the queries of a test module that asks for this read them."""
    from planlake.queries import files, insql, plandata, plans, series
    from planlake.queries.registry import Tables

    path = str(tmp_path_factory.mktemp("plans"))
    made = plandata.order_plans
    made(Tables(spark, sf)).coalesce(4).write.mode("overwrite").parquet(path)
    modules = [m for m in (files, insql, plandata, plans, series) if hasattr(m, "order_plans")]
    for m in modules:
        m.order_plans = lambda t: spark.read.parquet(path)
    yield made
    for m in modules:
        m.order_plans = made
