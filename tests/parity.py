"""Rows of a Spark query and of its DuckDB oracle, in a form that compares."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT"}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, float):
        return (1, repr(v + 0.0))
    return (1, str(v))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for f in df.schema.fields:
        want = TYPES.get(f.dataType.simpleString())
        assert want is None or want == kinds[f.name], (f.name, want, kinds[f.name])
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
