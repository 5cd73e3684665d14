"""Runs a query and its DuckDB SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    norm = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    got = norm(df.select(*columns).collect())
    assert got == norm(want)
    return got
