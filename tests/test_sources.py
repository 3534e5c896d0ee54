"""Text files and streaming ingest."""

from folioscope.sources import files
from folioscope.streaming import jobs


def test_folder_of_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("one\ntwo\fthree".encode())
    (tmp_path / "sub" / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "f.txt").write_bytes(b"a\x00b")
    (tmp_path / "~$d.txt").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes("first\n\nsecond\nstill second".encode())
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert {k: v.status for k, v in got.items()} == {"a.txt": "ok", "b.txt": "ok", "e.txt": "ok", "f.txt": "binary"}
    assert got["b.txt"].text == "café"
    parts = [(r.path.rsplit("/", 1)[1], r.page, r.text) for r in files.blocks(files.read_folder(spark, str(tmp_path)).filter("status = 'ok'")).collect()]
    assert {("a.txt", 1, "one"), ("a.txt", 1, "two"), ("a.txt", 2, "three"), ("e.txt", 1, "first"), ("e.txt", 1, "second still second")} <= set(parts)


def test_ingest_skips_what_is_known(spark, tmp_path):
    source, known, mark = str(tmp_path / "in"), str(tmp_path / "known"), str(tmp_path / "mark")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(source)
    jobs.ingest(stream(), known, mark)
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").write.mode("append").parquet(source)
    jobs.ingest(stream(), known, mark)
    assert sorted(r.text for r in spark.read.parquet(known).collect()) == ["a", "b", "c"]
