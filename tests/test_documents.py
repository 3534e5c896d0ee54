"""Queries that are answered within a document's row: no shuffle of words, and the rows of their SQL on odd texts and repeated keys."""

import duckdb
import pytest

from folioscope.plans import catalog
from tests.test_catalog import plain

PHRASE = "strong winds carried yellow leaves across quiet northern valleys today"
TEXTS = [
    (1, f"{PHRASE}\nOther words: {PHRASE}\n\nand once more {PHRASE} and {PHRASE}"),
    (2, f"{PHRASE}\n{PHRASE}"),
    (3, None),
    (4, ""),
    (5, "References\n" + "\n".join([PHRASE] * 3) + "\n1. Introduction\n" + PHRASE + "\n| " + PHRASE + " |\nx = 1 + 2 = 3"),
    (6, "ь сильный ветер нёс жёлтые листья над тихой долиной\n" * 3 + 'the text says "' + PHRASE + '" [3], as «' + PHRASE + "» does (Smith 2001) too"),
    (None, PHRASE + " Ўзбекистон o‘zbek Élève"),
]


def write(spark, path, rows):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")


def same_as_sql(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(path))
    cols = sorted(df.columns)
    got = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == theirs
    return df, theirs


WITHIN = ["h1_shingles", "h8_repeated_phrases", "i1_hash_embedding"]


@pytest.mark.parametrize("name", WITHIN)
def test_no_shuffle_and_the_rows_of_the_sql(spark, tmp_path, name):
    write(spark, tmp_path, TEXTS)
    df, rows = same_as_sql(spark, tmp_path, name)
    assert rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", WITHIN)
def test_repeated_keys_go_by_the_sql(spark, tmp_path, name):
    """Rows that share a key count as one document; the one that repeats is empty here, so no order is left open."""
    write(spark, tmp_path, [*TEXTS, (1, ""), (2, None), (None, "")])
    _, rows = same_as_sql(spark, tmp_path, name)
    assert rows


def test_a_phrase_counts_each_passage_once(spark, tmp_path):
    write(spark, tmp_path, TEXTS[:2])
    got = {(r.doc_id, r.n, r.phrase): r.passages for r in catalog.QUERIES["h8_repeated_phrases"](spark, str(tmp_path)).collect()}
    assert got[1, 9, PHRASE.rpartition(" ")[0]] == 3 and {k[0] for k in got} == {1}
