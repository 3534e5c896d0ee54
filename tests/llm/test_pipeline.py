"""Every stage of the pipeline on rows with repeated and null keys, odd texts and none at all."""

from collections import Counter

import pytest

import corpus_pipeline
from folioscope.llm.common import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, removed string"
DATA = "/root/testdata/sf0.001"


def prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


TEXTS = [
    (1, prose(1)), (5, prose(2)), (5, prose(3)), (6, prose(2)), (7, prose(4) + " changed"), (8, prose(4)), (None, prose(5)), (None, prose(5)), (None, prose(6)), (9, None), (10, ""),
    (10, ""), (11, "one two"), (12, "é " * 20_000), (1, prose(1)),
]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", ["a", "b", None][i % 3], len(t or ""), 7, "x") for i, (d, t) in enumerate(rows)], SCHEMA)


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows_give_no_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs(spark, []), DATA).count() == 0


def test_toxicity_keeps_clean_rows(spark):
    got = corpus_pipeline.drop_toxic(spark, docs(spark, TEXTS), DATA)
    assert got.columns == corpus_pipeline.COLUMNS and rows(got) == Counter(TEXTS)


def test_line_dedup_tells_rows_of_one_key_apart(spark):
    got = rows(corpus_pipeline.drop_repeated_lines(spark, docs(spark, TEXTS), DATA))
    want = Counter(TEXTS)
    # the text of 6 stands in the older 5, the changed line of 7 comes before that of 8
    for gone in ((6, prose(2)), (8, prose(4))):
        del want[gone]
    assert got == want


def test_one_row_of_each_group_stays(spark):
    got = rows(corpus_pipeline.drop_near_duplicates(spark, docs(spark, TEXTS), DATA))
    want = Counter(TEXTS) - Counter([(6, prose(2)), (8, prose(4)), (None, prose(5)), (1, prose(1))])
    assert got == want


def test_mixing_multiplies_no_row_by_its_key(spark):
    given = Counter(TEXTS)
    got = rows(corpus_pipeline.mix_sources(spark, docs(spark, TEXTS), DATA))
    assert set(got) <= set(given) and all(n <= 3 * given[r] for r, n in got.items())
    size = {r: len(words(r[1])) for r in given}
    assert abs(sum(n * size[r] for r, n in got.items()) - sum(n * size[r] for r, n in given.items())) <= 20_000
    assert got == rows(corpus_pipeline.mix_sources(spark, docs(spark, TEXTS), DATA))


def test_tokens_decode_to_the_texts(spark):
    import hashlib

    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.tokenize(spark, docs(spark, TEXTS), DATA).collect())
    assert got == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in TEXTS)
