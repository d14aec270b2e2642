"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from driftline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, (list, tuple)):
        return [same(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([same(v) for v in row]) for row in df.select(*columns).collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(d[0] for d in result.description) == columns
    assert got == sorted(str([same(row[i]) for i in at]) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("name", ["q04_asof_backward", "q08_unwrap_angle", "q19_decimate_blocks"])
def test_no_cross_join_and_pruned_columns(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shortest_paths_of_all_suppliers(spark):
    """Against brute-force Dijkstra."""
    import heapq

    sf_dir = "/root/testdata/sf0.01"
    near = {}
    for row in catalogue._lattice(spark, sf_dir).select("node1", "node2", "length").collect():
        near.setdefault(row.node1, []).append((row.node2, row.length))
        near.setdefault(row.node2, []).append((row.node1, row.length))
    want = {}
    for (k,) in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect():
        heap = [(k % 4 * 10.0, f"{k % 10 * 200}:{k % 7 * 200}")]
        while heap:
            d, node = heapq.heappop(heap)
            if d <= 350 and (k, node) not in want:
                want[k, node] = round(d, 6)
                for other, length in near.get(node, ()):
                    heapq.heappush(heap, (d + length, other))
    got = {(r.source, r.node): r.distance for r in catalogue.queries()["q53_bounded_shortest_path_all"](spark, sf_dir).collect()}
    assert max(k for k, _ in got) > 40 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)
