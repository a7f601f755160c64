"""Every named query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from formlake.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def norm(rows):
    return sorted((tuple("" if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(cols).collect()
    if name in ORACLE:
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert norm(map(tuple, got)) == norm(con.sql(f"select {quoted} from ({ORACLE[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["jn_line_pairs", "vd_contradiction", "jn_containment", "ag_key_match", "jn_open_points"])
def test_no_product_of_tables(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def against_sql(spark, tmp_path):
    """A function that runs a query and its SQL on small tables (name: SELECT) and gives the rows of both."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, select in tables.items():
            con.sql(f"copy ({select}) to '{tmp_path}/{t}.parquet' (format parquet)")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        quoted = ", ".join(f'"{c}"' for c in df.columns)
        return norm(map(tuple, df.collect())), norm(con.sql(f"select {quoted} from ({ORACLE[name]})").fetchall())

    return run


def test_prices_round_as_in_sql(against_sql):
    orders = "select 63090 as o_orderkey, 4096 as o_custkey, 15099.81::double as o_totalprice, '4-NOT SPECIFIED' as o_orderpriority, 'P' as o_orderstatus union all select 98609, 4096, 345607.48, '5-LOW', 'O' union all select 1, 7, 2.5, '5-LOW', 'P'"
    got, expected = against_sql("jn_best_occurrence", orders=orders)
    assert got == expected and (4096, 63090) in got
