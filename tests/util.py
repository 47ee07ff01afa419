"""Comparison of a Spark result with DuckDB SQL over the same tables."""

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    want = con.execute(sql).fetchdf()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

