"""Invariants and golden cases of tokens and fingerprints."""

from folioscope.functions import profiles
from folioscope.operators import tokens as tk
from folioscope.plans import catalog


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_short_documents_keep_all_shingles(spark):
    text = "seven pretty words stand here for testing"
    sh = tk.shingles(tk.tokens(docs(spark, text)), profiles.STOP_EN)
    assert sh.count() == 2 and tk.winnow(sh).count() == 2


def test_empty_and_null_texts_have_no_tokens(spark):
    assert tk.tokens(docs(spark, "", None, " \n ")).count() == 0


def test_shared_run_of_nine_words_is_found(spark):
    run = "alpha bravo charlie delta echo foxtrot golf hotel india"
    a = tk.winnow(tk.shingles(tk.tokens(docs(spark, "before words come first " + run + " other words after that")), []))
    b = tk.shingles(tk.tokens(docs(spark, "nothing alike stands here " + run + " completely new ending")), [])
    assert a.join(b, "h").count() >= 1


def test_sentences_split_at_capitals(spark):
    got = [r.sentence for r in tk.sentences(docs(spark, "One is here. Two is there! and not three.\nFour?")).orderBy("idx", "n").collect()]
    assert got == ["One is here.", "Two is there! and not three.", "Four?"]


def test_canonical_words_meet_across_scripts(spark):
    got = {r.id: r.canonical for r in catalog.QUERIES["b12_canonical_word"](spark, "/root/testdata/sf0.001").collect()}
    assert got[1] == got[2] == got[3] == "kitob" and got[9] == "ma'no"


def test_languages_and_profiles(spark, tmp_path):
    texts = [
        "Bu kitob juda yaxshi va barcha o'quvchilar uchun kerak, chunki unda har bir mavzu alohida ko'rib chiqilgan.",
        "Эта книга является очень полезной для всех учеников, потому что в ней есть всё, что надо знать об этом.",
        "This book is very useful for all of the pupils because it has everything that they should know about it.",
        "zzz qqq www vvv",
        "two words",
        "Ўқувчи китоб ўқиди ва қишлоққа борди",
    ]
    rows = [(i, t, "x", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.code for r in catalog.QUERIES["m1_language"](spark, str(tmp_path)).collect()}
    assert got == {0: "uz", 1: "ru", 2: "en", 3: "unknown", 4: "unknown", 5: "unknown"}


def test_signals_of_a_known_text(spark, tmp_path):
    """Counts taken by hand: four sentences of 10, 10, 10 and 9 words, two of them starting with a marker."""
    text = "However, the method by A. Karimov is robust and key results, tables and figures help. However, the method of e.g. Smith is a various analysis of data today. The pupils of the school read all of it in 2001 [3]. It is important to note that this is the end."
    rows = [(1, text, "en", "s", len(text))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    r = catalog.QUERIES["l1_features"](spark, str(tmp_path)).first()
    assert (r.code, r.n_sentences) == ("en", 4) and r.transition_start_ratio == 0.5 and r.opening_repetition == 0.5
    assert abs(r.generic_phrase_density - 100 / r.n) < 1e-5 and abs(r.qualifier_density - 300 / r.n) < 1e-5 and r.triad_density == 0.25
