"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (least node reachable) for every node of edges (a, b); loops and repeats do not matter.

    Least neighbours are pre-aggregated before they are shuffled, and a node of very many links is
    split by the skew handling of the join. Each round is written, and the one before removed.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots).distinct()
