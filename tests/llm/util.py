import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def same_rows(df, sql):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    c = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted((tuple(r[names.index(x)] for x in cols) for r in rel.fetchall()), key=repr)
    have = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr)
    assert have == want
