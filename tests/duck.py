"""Rows of a query and of its SQL, in one order and form."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def both(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    wanted = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    return sorted(got, key=repr), sorted(wanted, key=repr)
