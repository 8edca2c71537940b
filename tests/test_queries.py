"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import math
import os

import pytest

from citelake.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def base():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, base, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    ran = base.execute(registry.ORACLES[name])
    names = [x[0] for x in ran.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["entries_of_records", "enriched_entries"])
def test_long_author_lists_and_blanks_equal_sql(spark, tmp_path, name):
    """More than 20 authors (met only in large tables), and first lines with no-break and wide blanks or none but such."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, k % 7 AS o_custkey, 'P' AS o_orderstatus, TIMESTAMP '1995-03-04' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM range(12) r(k)")
    con.execute("CREATE TABLE lineitem AS SELECT k AS l_orderkey, 20 - s AS l_partkey, s AS l_suppkey FROM range(12) r(k), range(25) q(s) WHERE s < 2 * k + 2 AND s < 20")
    con.execute("CREATE TABLE part AS SELECT k AS p_partkey, 'Brand#1' AS p_brand FROM range(30) r(k)")
    con.execute("CREATE TABLE documents AS SELECT k AS doc_id, [chr(160) || 'A title of this length' || chr(12288), '  plain blanks at its ends ', chr(160) || chr(8195), 'a feed' || chr(13), chr(9)][k % 6 + 1] || chr(10) || 'more' AS text FROM range(12) r(k)")
    for t in ("orders", "lineitem", "part", "documents"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    ran = con.execute(registry.ORACLES[name])
    names = [x[0] for x in ran.description]
    expected = sorted(tuple(plain(x) for x in r) for r in ran.fetchall())
    assert len(expected) == 12 and sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == expected
