"""Mixing sources to target weights by entropy balancing.

Of all document rates that meet the token target of each source, the one of least relative entropy
to "every document once" is an exponential tilt of the document's size, cut at the cap:
rate = min(cap, exp(lambda * size / scale)), with one lambda a source. The dual is convex in each
lambda; guarded Newton steps solve it, each one aggregation over cells of equal source and size.
Rates then become whole copies: cell by cell, from the largest size down, the copies follow the
running sum of wanted tokens, so that the error of a source ends below one small document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, word_count, written

#: Documents of one cell that one task ranks, on average.
CELL_ROWS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sid, source_size, target from sid, source, source_size: shares by weight, filled up to cap times the size.

    One row a source. Weights repeat over the sources in code point order, null last. What is above
    a source's cap is shared among the others by weight, until none is above.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    base = checkpoint(sizes.select("sid", "source_size", weight.alias("w")))
    total = base.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, F.lit(False)
    for _ in range(base.count() + 1):
        full, rest = base.agg(F.sum(F.when(capped, F.col("source_size") * cap)), F.sum(F.when(~capped, F.col("w")))).first()
        if not rest:
            break
        new = (total - (full or 0.0)) / rest
        if level is not None and new <= level:
            break
        level = new
        capped = F.col("w") * level > F.col("source_size") * cap
    share = F.lit(0.0) if level is None else F.least(F.col("w") * level, F.col("source_size") * cap)
    return base.select("sid", "source_size", share.cast("double").alias("target"))


def tilt(cells: DataFrame, targets: DataFrame, cap: float, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """sid, lam, scale: the dual solution of every source, by Newton steps kept inside a bracket."""
    def exact(x: Column) -> Column:
        """Decimal sums do not depend on the order of the rows, so reruns agree to the last digit."""
        return F.sum(x.cast("decimal(38,9)")).cast("double")

    squares = F.col("n").cast("double") * F.col("size") * F.col("size")
    scale = cells.groupBy("sid").agg((exact(squares) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    state = checkpoint(
        targets.join(scale, "sid").select(
            "sid", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full")
        )
    )
    x = F.col("size") / F.col("scale")
    raw = F.exp(F.least(F.col("lam") * x, F.lit(60.0)))
    for _ in range(rounds):
        tokens = F.col("n") * F.col("size")
        sums = cells.join(state, "sid").groupBy("sid").agg(exact(tokens * F.least(raw, F.lit(cap))).alias("got"), exact(F.when(raw < cap, tokens * x * raw).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.col("slope")
        middle = F.when(high >= 1e6, F.col("lam") * 2 + 1).when(low <= -1e6, F.col("lam") * 2 - 1).otherwise((low + high) / 2)
        near = F.abs(gap) <= F.greatest(F.col("target") * tolerance, F.lit(1e-6))
        lam = F.when(F.col("full") | near, F.col("lam")).when((F.col("slope") > 0) & (step > low) & (step < high), step).otherwise(middle)
        state = checkpoint(state.join(sums, "sid").select("sid", "target", "scale", lam.alias("lam"), low.alias("low"), high.alias("high"), "full", (F.col("full") | near).alias("near")))
        if not state.filter(~F.col("near")).limit(1).count():
            break
        state = state.drop("near")
    return state.select("sid", "lam", "scale", "full")


def _copies(cap: float):
    def fold(cells: pd.DataFrame) -> pd.DataFrame:
        """Copies of every size of one source: largest first, each follows the tokens still wanted. One row a size."""
        cells = cells.sort_values("size", ascending=False)
        wanted = taken = 0.0
        out = []
        for n, size, rate in zip(cells["n"], cells["size"], cells["rate"], strict=True):
            wanted += n * size * rate
            m = int(round(n * rate)) if size == 0 else int(min(max((wanted - taken) / size + 0.5, 0), int(cap * n)))
            taken += m * size
            out.append(m)
        return cells.assign(m=out)[["sid", "size", "n", "m"]]

    return fold


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, order: Column | None = None) -> DataFrame:
    """key, source, size, source_size, target, copies of every document.

    Sizes are words; a null or empty text has size 0 and one copy at most counts nothing. A null source is a
    source of its own, the last. Repeated rows are documents of their own. A null key is a key like any
    other. An empty table gives no rows. Rates and copies depend on the rows alone, so reruns agree; equal
    rows may swap their copies. order: what decides between documents of one size, the key if None.
    """
    sid = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select(docs[key].alias("key"), docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size"), (docs[key] if order is None else order).alias("order"))
    rows = written(rows.select("key", "source", sid.alias("sid"), "size", F.xxhash64(F.lit(10), "order").alias("u")), "sizes")
    salts = 1 + rows.count() // CELL_ROWS
    rows = rows.withColumn("salt", F.pmod("u", F.lit(salts)))
    cells = checkpoint(rows.groupBy("sid", "source", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    sizes = cells.groupBy("sid", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = checkpoint(source_targets(sizes, weights, cap))
    whole = checkpoint(cells.groupBy("sid", "size").agg(F.sum("n").alias("n")))
    solved = tilt(whole, targets, cap)
    rate = F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(60.0))), F.lit(cap)))
    counted = whole.join(solved, "sid").select("sid", "size", "n", rate.alias("rate")).groupBy("sid").applyInPandas(_copies(cap), "sid string, size long, n long, m long")
    # a size's copies go to its salts in proportion to their rows
    upto = F.sum("part").over(Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = counted.withColumnRenamed("n", "all").join(cells.select("sid", "size", "salt", F.col("n").alias("part")), ["sid", "size"]).withColumn("upto", upto)
    share = F.floor(F.col("upto") * F.col("m") / F.col("all")) - F.floor((F.col("upto") - F.col("part")) * F.col("m") / F.col("all"))
    counted = checkpoint(shared.select("sid", "size", "salt", F.col("part").alias("n"), share.alias("m")))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy("u", "key"))
    copies = F.floor(F.col("rank") * F.col("m") / F.col("n")) - F.floor((F.col("rank") - 1) * F.col("m") / F.col("n"))
    return (
        rows.withColumn("rank", rank)
        .join(counted, ["sid", "size", "salt"])
        .join(targets, "sid")
        .select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.cast("int").alias("copies"))
    )
