"""Text files as documents: decoding, page breaks and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """UTF-8 (with or without a byte order mark) if the bytes are valid UTF-8, else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "utf-8")).otherwise(F.decode(content, "iso-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def read_folder(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, text, status of the .txt files below a folder; names that begin with a dot or ~$ are left out.

    Files with NUL bytes have the status binary and no text; Spark does not list empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    files = files.filter(~F.col("path").rlike("/([.]|~[$])[^/]*$"))
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    bad = F.when(F.hex("content").rlike("^(?:..)*00"), "binary").otherwise("ok")
    return files.select("path", F.when(bad == "ok", decoded(F.col("content"))).alias("text"), bad.alias("status"))


def blocks(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, page, idx, text: form feeds end pages; blank lines part paragraphs if there are enough of them, else lines do."""
    pages = docs.select(key, F.posexplode(F.split("text", "\f")).alias("page", "body"))
    blank = F.regexp_count("body", F.lit("\n[ \t]*\n"))
    by_blank = blank >= F.greatest(F.lit(1), F.floor((F.regexp_count("body", F.lit("\n")) + 1) / 10))
    parts = F.when(by_blank, F.split("body", "\n[ \t]*\n")).otherwise(F.split("body", "\n"))
    rows = pages.select(key, (F.col("page") + 1).alias("page"), F.posexplode(parts).alias("idx", "text"))
    return rows.select(key, "page", "idx", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text")).filter("text <> ''")
