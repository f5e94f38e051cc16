import duckdb
import pytest

import __spark_entry__ as entry
from tripleweave import catalogue
from tripleweave.sources.tables import sample_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted(map(repr, values))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_agree_with_sql(spark, tables, name):
    got = entry.queries()[name](spark, SF)
    want = tables.sql(catalogue.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    wanted = [tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()]
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(wanted)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_is_one_scan_of_its_columns(spark):
    text = "select ?n ?b where { ?c a t:Customer ; t:c_name ?n ; t:c_acctbal ?b optional { ?c t:c_mktsegment ?m } filter(?b > 5000) }"
    found = plan(sample_graph(spark, SF).query(text).flat)
    assert found.count("FileScan parquet") == 1 and "Generate" not in found and "c_custkey" not in found
    assert "GreaterThan(c_acctbal,5000.0)" in found


def test_joins_are_on_keys_and_constants_reach_the_scan(spark):
    found = plan(sample_graph(spark, SF).query("select ?c where { ?c t:c_nationkey ?n . ?n t:n_regionkey <http://example.org/tpch/region/3> }").flat)
    assert "EqualTo(n_regionkey,3)" in found and found.count("concat") == 1


def test_top_k_and_entry(spark):
    assert "TakeOrderedAndProject" in plan(sample_graph(spark, SF).query("select ?n where { ?c t:c_name ?n } order by ?n limit 5").flat)
    assert entry.entry(spark).count() >= 0


def test_streams(spark, tmp_path):
    from dataclasses import replace

    from tripleweave.functions.terms import IRI
    from tripleweave.operators import shacl as S
    from tripleweave.sources.tables import BASE
    from tripleweave.streaming.validation import stream_violations, validated

    table = next(t for t in sample_graph(spark, SF).tables if t.name == "events")
    (tmp_path / "in").mkdir()
    table.df.write.parquet(str(tmp_path / "in/a"))
    table = replace(table, source=spark.readStream.schema(table.df.schema).parquet(str(tmp_path / "in/*")))
    shape = S.NodeShape(IRI(BASE + "S"), (S.TargetClass(IRI(BASE + "Events")),), (), (S.PropertyShape(IRI(BASE + "value"), (S.MaxExclusive(50), S.MinCount(1))),))
    query = stream_violations(table, [shape]).writeStream.format("memory").queryName("bad").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    seen = []
    other = validated(table, [shape], lambda df, bad, n: seen.append(bad.count()), str(tmp_path / "d"))
    other.processAllAvailable()
    other.stop()
    high = spark.read.parquet(f"{SF}/events.parquet").where("value >= 50").count()
    assert spark.table("bad").count() == high == sum(seen) > 0
