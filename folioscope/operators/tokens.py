"""Paragraphs, tokens, sentences, shingles and fingerprints of many documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import profiles

#: Words of a shingle, and shingles of a winnowing window.
K, WINNOW = 6, 4


def h60(x: Column) -> Column:
    """The first 60 bits of md5: a hash that SQL engines agree on."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text of every line that is not blank (idx counts all lines, from 0)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.select("doc_id", "idx", F.trim("text").alias("text")).filter("text <> ''")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word (lower case) in order."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(profiles.WORD), 0)).alias("pos", "word"))


def paragraph_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, idx, pos, word: tokens counted within their paragraph."""
    rows = paragraphs(docs)
    return rows.select("doc_id", "idx", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(profiles.WORD), 0)).alias("pos", "word"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, idx, n, sentence: pieces of a paragraph that hold a word."""
    marked = F.regexp_replace("text", profiles.SENTENCE_END, "$1\x1e$2")
    rows = paragraphs(docs).select("doc_id", "idx", F.posexplode(F.split(marked, "\x1e")).alias("n", "sentence"))
    return rows.filter(F.col("sentence").rlike("[\\p{L}\\p{Nl}\\p{No}]"))


def stop_words(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted({w for ws in profiles.STOP.values() for w in ws})], "word string")


def shingles(tokens_: DataFrame, stop: list[str], key: tuple[str, ...] = ("doc_id",), k: int = K, longer: int = 1) -> DataFrame:
    """key, pos, h of the k-word shingles with two content words (no stop word, more than `longer` letters) at least."""
    w = Window.partitionBy(*key).orderBy("pos")
    content = (~F.col("word").isin(stop) & (F.length("word") > longer)).cast("int")
    rows = tokens_.withColumn("content", content)
    grams = [F.col("word"), *(F.lead("word", i).over(w) for i in range(1, k))]
    rows = rows.select(*key, "pos", F.concat_ws(" ", *grams).alias("gram"), grams[-1].alias("end"), F.sum("content").over(w.rowsBetween(0, k - 1)).alias("content"))
    return rows.filter("end is not null and content >= 2").select(*key, "pos", h60(F.col("gram")).alias("h"))


def winnow(shingles_: DataFrame, key: tuple[str, ...] = ("doc_id",), window: int = WINNOW) -> DataFrame:
    """key, pos, h of the least hash of each window of shingles, the rightmost of equals; all if there are few."""
    w = Window.partitionBy(*key)
    order = w.orderBy("pos")
    rows = shingles_.select(*key, "pos", "h", F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(order).alias("i"), F.min(F.struct("h", (-F.col("pos")).alias("p"))).over(order.rowsBetween(0, window - 1)).alias("least"))
    few = rows.filter(F.col("n") <= window).select(*key, "pos", "h")
    many = rows.filter((F.col("n") > window) & (F.col("i") <= F.col("n") - window + 1)).select(*key, (-F.col("least.p")).cast("int").alias("pos"), F.col("least.h").alias("h"))
    return few.unionByName(many).distinct()
