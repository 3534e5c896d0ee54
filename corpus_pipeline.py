"""From raw documents to token ids: the stages, and run(), which applies them in turn.

Every stage takes (spark, docs, sf_dir), with docs as its predecessor wrote them, and returns the columns of
documents; the last returns tokens. In all stages rows are documents, not keys: rows that share a doc_id or have
none are told apart, null and empty texts stay (they are neither toxic nor repeated), other columns are passed
over, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, linededup, minhash, mixing, toxicity
from folioscope.llm.common import discard, table, word_count, written
from folioscope.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of this score or more are rejected.
TOXIC = 0.3


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own in column row; written, so that each keeps its number."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; texts and all else unchanged. Repeated rows share their score."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(4))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that held nothing else go. n_chars follows the text.

    Which line is the first is a matter of doc_id (null last) and a hash of the text; rows that repeat both
    keep the same lines. A document that lost no line stays, whatever its text is.
    """
    left = linededup.dedup(docs.select(*COLUMNS))
    left = left.filter((F.size("removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that of least doc_id, null last.

    Repeated rows are near-duplicates like others. Documents without a word have no shingles, so all of them stay.
    """
    rows = _numbered(docs)
    groups = minhash.near_duplicates(rows, key="row", k=5, percent=80).select("row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    best = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("best"))
    return rows.join(best.select("best.row"), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeats are equal rows.

    Which of several documents of one source and size is taken is a matter of doc_id and a hash of the text.
    """
    rows = _numbered(docs)
    order = F.struct("doc_id", F.xxhash64("text").alias("mark"))
    copies = mixing.mix(rows, key="row", order=order).filter("copies > 0").select("row", "copies")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32), n_words and a digest of the text decoded from the ids, per row."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return ids.select("doc_id", "n_tokens", "ids", word_count(F.col("decoded")).alias("n_words"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_duplicates), ("mixing", mix_sources), ("tokens", tokenize)]
#: SQL expresses neither the classifier nor the sketches nor the tilt.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if at:
            discard(before)
    return docs
