"""The thin opN_ queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import ann, bpe, chat, fingerprint, html, linededup, minhash, mixing, pylm, toxicity
from folioscope.llm.common import table


def op1_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0, k=20)


def held_out(modulus: int, key: str = "doc_id") -> Column:
    """Whether a row is held out: crc32 of the key as text leaves remainder 2. A null key is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus)) == 2, F.lit(False))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pylm.score(table(spark, sf_dir, "documents"), ~held_out(7))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(4))
    return toxicity.score(docs, model).select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = bpe.decode(ids, ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op8_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return docs.select("doc_id", lines.alias("n_lines_kept"), F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.compare_edited(table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_similarity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    back = chat.read_back(chat.format_trees(chat.chain(rows.union(probe))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    "op1_block_join": op1_block_join,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_compression_toxicity": op3_compression_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_similarity_sketches": op5_similarity_sketches,
    "op6_reply_trees": op6_reply_trees,
    "op7_layout_text": op7_layout_text,
    "op8_edit_join": op8_edit_join,
    "op9_weighted_sampling": op9_weighted_sampling,
    "op10_entropy_mix": op10_entropy_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op1_block_join": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_reduce(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]), lambda x, y: x + y) AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
