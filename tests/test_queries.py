"""Every query against its SQL."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(frame):
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}" if not math.isinf(x) else str(x)
        return f"{float(x):.6g}" if hasattr(x, "__float__") and not isinstance(x, str | bool) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, sf, duck, written_plans, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sentences_are_split_where_one_ends(spark):
    from planlake.functions.text import sentences

    df = spark.createDataFrame([("One here. Two there! three? \"Four\" ends.",)], "t string")
    assert df.select(sentences(F.col("t"))).first()[0] == ["One here.", "Two there! three?", '"Four" ends.']


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_make_their_plans_themselves(spark, sf, written_plans):
    """What the queries above read is what the makers of plans make."""
    from planlake.queries import plandata
    from planlake.queries.registry import Tables

    made, read = written_plans(Tables(spark, sf)), plandata.order_plans(Tables(spark, sf))
    assert made.schema.simpleString() == read.schema.simpleString()
    told = lambda df: df.select(F.to_json(F.struct("*")).alias("j"))
    assert told(made).exceptAll(told(read)).count() == 0 and made.count() == read.count() > 0


def test_committed_slices_give_cents_to_the_last(spark, sf, duck):
    got, want = QUERIES["q110_committed_slices"](spark, sf).collect(), duck.execute(SQL["q110_committed_slices"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
