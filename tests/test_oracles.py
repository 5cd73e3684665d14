"""Every query of the URL engine against its DuckDB SQL, over the same tables."""

import duckdb
import pytest

from weir.plans import registry, scan_queries

QUERIES, ORACLES = ({**getattr(registry, name), **getattr(scan_queries, name)} for name in ("QUERIES", "ORACLES"))
#: Tables large enough to hold rows for each query.
SF = {"f_host_strict": "/root/testdata/sf0.01"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    folder = SF.get(name, "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    norm = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got = norm(df.select(*columns).collect())
    cursor = con.execute(ORACLES[name])
    assert sorted(d[0] for d in cursor.description) == columns
    assert got and got == norm(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
