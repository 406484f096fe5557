"""Compares a query's rows with those of its DuckDB SQL, in any order."""

import glob
import math
import os

import duckdb


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def in_order(rows):
    """Rows as (all but their fractions as text, fractions), sorted; fractions that differ by rounding sort alike but for ties."""
    cut = [(tuple(shown(v) for v in r if not isinstance(v, float)), tuple(v for v in r if isinstance(v, float))) for r in rows]
    return sorted(cut, key=lambda r: (r[0], tuple((math.isnan(v), 0 if math.isnan(v) else v) for v in r[1])))


def assert_same(query, sql, spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    own = in_order([[r[c] for c in names] for r in df.collect()])
    other = con.execute(sql)
    at = [d[0] for d in other.description]
    assert sorted(at) == names
    theirs = in_order([[r[at.index(c)] for c in names] for r in other.fetchall()])
    assert [r[0] for r in own] == [r[0] for r in theirs]
    # sums of doubles in another order differ in their last digits, and where rounded lie on either side of a half
    for (key, a), (_, b) in zip(own, theirs):
        assert len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9) or math.isnan(x) and math.isnan(y) for x, y in zip(a, b)), (key, a, b)
