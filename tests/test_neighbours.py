"""Nearest vectors of a label: the rows of the SQL for copies, ties, repeated keys and odd vectors, without joining pairs in Spark."""

import duckdb
import numpy as np

from folioscope.plans import catalog
from tests.test_catalog import plain


def same_as_sql(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES["i_cosine_neighbours"](spark, str(path))
    cols = sorted(df.columns)
    got = con.execute(catalog.ORACLE_SQL["i_cosine_neighbours"])
    names = [x[0] for x in got.description]
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert theirs and sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == theirs
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(n):
    x = np.random.default_rng(5).integers(-3, 4, (n, 6)) + 0.5
    return [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]


def test_copies_ties_and_repeated_keys(spark, tmp_path):
    rows = vectors(400)
    same = [(1000 + i, rows[7][1], 1) for i in range(60)]
    scaled = [(2000 + i, [v * 2 for v in rows[7][1]], 1) for i in range(9)]
    again = [(1000, rows[7][1], 1)] * 5 + [(3, rows[9][1], 0), (5, rows[8][1], None)]
    plan = same_as_sql(spark, tmp_path, rows + same + scaled + again + [(9000, rows[0][1], 77)])
    assert "zip_with" not in plan


def test_a_missing_vector(spark, tmp_path):
    same_as_sql(spark, tmp_path, [*vectors(20), (100, None, 1)])
