"""Every registered query over the small tables: its rows equal its SQL's, and plans stay as they should be."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from noteloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(data, columns):
    order = sorted(columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(flat(r[columns.index(c)]) for c in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_the_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    r = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(r.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["backlinks_all", "resolve_edges", "degrees", "coalesce_intents", "deletion_index", "freshness_report", "search_phrase", "accept_hits"])
def test_plans(spark, name):
    """No cartesian product of tables, and no Python but in the YAML and chunk helpers."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "MapInPandas" not in plan and "BatchEvalPython" not in plan


def test_pushdown(spark):
    """A question about keys reads the two columns it needs."""
    plan = entry.queries()["list_objects"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
