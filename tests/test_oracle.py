"""Each query against its SQL."""

import duckdb
import pytest

from almanac import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels".split()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name, tmp_path):
    out = str(tmp_path / "out")
    catalog.queries()[name](spark, SF).write.parquet(out)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {catalog.oracle_sql()[name]}")
    con.execute(f"CREATE VIEW got AS SELECT * FROM '{out}/*.parquet'")
    names = lambda t: sorted(r[0] for r in con.execute(f"DESCRIBE {t}").fetchall())
    assert names("want") == names("got")
    columns = ", ".join(f'"{c}"' for c in names("want"))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchall() == [(0,)]
