"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import duckdb
import pytest

from thornwick import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def shown(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(q.ORACLES))
def test_equals_sql(spark, db, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = db.sql(q.ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    got = sorted(repr(tuple(shown(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(shown(r[i]) for i in at)) for r in relation.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scanned_packages_hold_every_document_and_manifest(spark):
    files = q.package_files(spark, "/root/testdata/sf0.01").select("pkg", "path").collect()
    ids = [r.doc_id for r in q.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id").collect()]
    parts = [str(r.p_partkey) for r in q.read(spark, "/root/testdata/sf0.01", "part").select("p_partkey").collect()]
    assert max(ids) >= 200
    for path in ("docs/d{}.md", "src/f{}.js"):
        assert {path.format(i) for i in ids} <= {r.path for r in files}
    assert sorted(r.pkg for r in files if r.path == "package.json") == sorted(parts)
    assert len(files) == 2 * len(ids) + len(parts)
