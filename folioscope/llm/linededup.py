"""Line de-duplication by a segment-partition edit join, with DataFrame functions only.

Equal lines are grouped first, so one row per distinct line remains. A line is a sequence of symbols: of words
if it has WORDS of them at least, of characters if it has fewer (lines close to that number are both). Lines
are near if their edit distance is at most the threshold, which grows with the length of the shorter (STEPS).
A line of n symbols is cut into threshold + 1 segments; if two lines are near, one segment of the
shorter occurs in the longer, shifted by no more than the edits before and behind it allow. Segments are
indexed by (length, number, hash), and probes look up the few runs of symbols that can match. Lines that meet
no other drop out there. Of the others every bucket is first compared with its oldest line alone, and
only lines that this does not settle are compared with all others, as one byte a symbol inside the join
condition, so that a group of like lines does not become rows. What is left is verified by a banded
bit-parallel edit distance.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, written

#: Lines of so many words are sequences of words, those of at most one more sequences of characters (too).
WORDS = 8
#: Threshold by number of symbols: (from so many on, edits); below the first, only equal lines are alike.
STEPS = {"chars": ((8, 1), (40, 2)), "words": ((8, 1), (40, 2), (80, 3))}
MOST = 3


def threshold(mode: Column, n: Column) -> Column:
    """Edits that a line of n symbols allows; mode is 0 for characters, 1 for words."""

    def steps(name: str) -> Column:
        out = F.lit(0)
        for least, edits in STEPS[name]:
            out = F.when(n >= least, edits).otherwise(out)
        return out

    return F.when(mode == 0, steps("chars")).otherwise(steps("words"))


def _specs(t: int, own: bool) -> Column:
    """(less, t, i, shift) of all runs of symbols that a line of threshold t looks up, or (own) is indexed under.

    Lines that are `less` symbols shorter may have a threshold of one edit less. Of the edits, at most i stand before
    segment i and at most t - i behind it.
    """
    found = []
    for edits in (t,) if own else (t, t - 1):
        for less in range(t - edits, 1 if own else edits + 1):
            for i in range(edits + 1):
                for shift in range(0 if own else max(-i, less - (edits - i)), 1 if own else min(i, less + (edits - i)) + 1):
                    if edits:
                        found.append((less, edits, i, shift))
    return F.array(*(F.struct(*(F.lit(v).alias(name) for v, name in zip(x, ("less", "t", "i", "shift"), strict=True))) for x in found))


def keys(rows: DataFrame, own: bool) -> DataFrame:
    """node, k: hashes of the segments (own), or of all runs of symbols where a near line, as long or shorter, may have one.

    The segments of a line are as equal as can be, the longer ones last. rows: node, mode, line.
    """
    symbols = F.when(F.col("mode") == 0, F.split("line", "")).otherwise(F.split("line", " "))
    # used twice below the explosion, u is made once a line; used only above it, it would be made again for every run
    rows = rows.select("node", "mode", symbols.alias("u")).withColumn("n", F.size("u"))
    t = threshold(F.col("mode"), F.col("n"))
    specs = F.when(t == 1, _specs(1, own)).when(t == 2, _specs(2, own)).otherwise(_specs(3, own))
    each = rows.select("node", "mode", "n", "u", F.explode(specs).alias("s"))
    each = each.select("node", "mode", "u", (F.col("n") - F.col("s.less")).alias("n"), "s").filter(threshold(F.col("mode"), F.col("n")) == F.col("s.t"))
    parts, i = F.col("s.t") + 1, F.col("s.i")
    base, short = F.floor(F.col("n") / parts).cast("int"), parts - F.col("n") % parts
    start, size = i * base + F.greatest(i - short, F.lit(0)) + 1 + F.col("s.shift"), base + (i >= short).cast("int")
    return each.select("node", F.xxhash64(i, "mode", "n", F.slice("u", start, size)).alias("k"))


def distance_within(a: Column, b: Column, t: Column, most: int = MOST) -> Column:
    """Whether the arrays a and b have an edit distance of t at most (t <= most).

    Bit most + d of word e says that i symbols of a and i + d of b can be passed with e edits, |d| <= most. One
    step per symbol of a moves all diagonals of the band at once: along a match, and from the word of
    one edit less by replacing (same diagonal), dropping a's symbol (one down) or taking one of b (one up).
    """
    width = 2 * most + 1
    full = (1 << width) - 1

    def masks(both: Column) -> Column:
        def bits(i: Column) -> Column:
            out = F.lit(0)
            for d in range(-most, most + 1):
                out = out + F.when(F.get(both["b"], i + d) == F.get(both["a"], i), 1 << (most + d)).otherwise(0)
                out = out + F.when((i + 1 + d >= 0) & (i + 1 + d <= both["m"]), 1 << (width + most + d)).otherwise(0)
            return out

        return F.when(both["n"] > 0, F.transform(F.sequence(F.lit(0), both["n"] - 1), bits)).otherwise(F.array().cast("array<int>"))

    # bound as a lambda's variable, so that the arrays are made once a pair, not once a step
    both = F.struct(a.alias("a"), b.alias("b"), F.size(a).alias("n"), F.size(b).alias("m"))
    steps = F.flatten(F.transform(F.array(both), masks))

    def step(words: Column, mask: Column) -> Column:
        hit, ok = mask.bitwiseAND(F.shiftright(mask, width)), F.shiftright(mask, width)
        new = [words["w0"].bitwiseAND(hit)]
        for e in range(1, most + 1):
            before = words[f"w{e - 1}"]
            moved = words[f"w{e}"].bitwiseAND(hit).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(moved.bitwiseAND(ok).bitwiseAND(full))
        return F.struct(*(x.alias(f"w{e}") for e, x in enumerate(new)))

    start = F.struct(*(F.lit(sum(1 << (most + d) for d in range(e + 1))).alias(f"w{e}") for e in range(most + 1)))

    def ends(words: Column) -> Column:
        """The word of t edits, which holds the pair's own diagonal or not."""
        out = words["w0"]
        for e in range(1, most + 1):
            out = F.when(t >= e, words[f"w{e}"]).otherwise(out)
        return out

    last = F.aggregate(steps, start, step, ends)
    near = F.abs(F.size(a) - F.size(b)) <= t
    return near & (last.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.when(near, F.size(b) - F.size(a) + most).otherwise(0))) != 0)


def word_number(line: Column) -> Column:
    """Number of the words of a line: what stands between spaces."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _modes(lines: DataFrame) -> DataFrame:
    """node (twice the id, plus the mode), mode, line, n of every line that can be near another; some lines in both modes."""
    words = F.col("words")
    as_ = [F.struct(F.lit(0).alias("mode"), F.length("line").alias("n")), F.struct(F.lit(1).alias("mode"), words.alias("n"))]
    both = F.when(words < WORDS, F.array(as_[0])).when(words <= WORDS + 1, F.array(*as_)).otherwise(F.array(as_[1]))
    rows = lines.select("id", "first", "line", F.explode(both).alias("x")).filter(threshold(F.col("x.mode"), F.col("x.n")) > 0)
    return rows.select((F.col("id") * 2 + F.col("x.mode")).alias("node"), "id", "first", "x.mode", "line", "x.n")


def near_lines(lines: DataFrame) -> DataFrame:
    """id of every line that is near a line that comes before it in the order of (first, id).

    lines: id (below 2^62), line, words (as of word_number), first; one row per distinct line.
    """
    rows = _modes(lines)
    index, probe = keys(rows, True).toDF("b", "k2"), keys(rows, False).toDF("a", "k")
    # an index row is a probe row of its own line, too, so only rows of other lines count
    # two lines of a key say whether there is another one, so the hashed side has one row a key
    ends = index.repartition("k2").groupBy("k2").agg(F.min("b").alias("low"), F.max("b").alias("high")).hint("shuffle_hash")
    probe = written(probe.join(ends, (F.col("k") == F.col("k2")) & ((F.col("a") != F.col("low")) | (F.col("a") != F.col("high"))), "left_semi").distinct(), "probes")
    index = written(index.join(probe.select("k").distinct().hint("shuffle_hash"), F.col("k2") == F.col("k"), "left_semi").select("b", F.col("k2").alias("k")), "indexed")
    ids = probe.select(F.col("a").alias("node")).union(index.select(F.col("b").alias("node"))).distinct()
    symbols = F.transform(F.when(F.col("mode") == 0, F.split("line", "")).otherwise(F.split("line", " ")), lambda x: F.xxhash64(x))
    code = F.array_join(F.transform("u", lambda x: F.chr((F.pmod(x, F.lit(127)) + 1).cast("int"))), "")
    some = rows.join(ids, "node", "left_semi").select("node", "id", "mode", "first", symbols.alias("u"))
    texts = written(some.withColumn("code", code), "units")

    def side(table: DataFrame, name: str, as_: str) -> DataFrame:
        """k, and as_: the order, the mode and the code of the line of name."""
        about = texts.select(F.col("node").alias(name), F.struct("first", "id", "node", "mode", "code").alias(as_))
        return table.join(about, name).select("k", as_)

    def alike(x: str, y: str) -> Column:
        """Whether the codes, and so perhaps the lines, are within the threshold."""
        edits = threshold(F.col(f"{x}.mode"), F.least(F.length(f"{x}.code"), F.length(f"{y}.code")))
        return F.call_function("levenshtein", F.col(f"{x}.code"), F.col(f"{y}.code"), edits) >= 0

    def verified(pairs: DataFrame) -> DataFrame:
        """id of the later line of those pairs of nodes (a, b; a the later) that are near."""
        one = texts.select(F.col("node").alias("a"), "id", "mode", F.col("u").alias("x"))
        two = texts.select(F.col("node").alias("b"), F.col("u").alias("y"))
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = pairs.join(one, "a").join(two, "b").repartition(parts, "a", "b")
        edits = threshold(F.col("mode"), F.least(F.size("x"), F.size("y")))
        return both.filter(distance_within(F.col("x"), F.col("y"), edits)).select("id").distinct()

    one, two = side(probe, "a", "p"), side(index, "b", "q")
    members = one.select("k", F.col("p").alias("m")).union(two.select("k", F.col("q").alias("m")))
    oldest = members.groupBy("k").agg(F.min("m").alias("c"))
    stars = members.join(oldest, "k").filter((F.col("m.id") != F.col("c.id")) & alike("m", "c"))
    settled = written(verified(stars.select(F.col("m.node").alias("a"), F.col("c.node").alias("b")).distinct()), "settled")
    done = settled.withColumn("done", F.lit(True))

    def open_(table: DataFrame, name: str) -> DataFrame:
        return table.join(done, F.col(f"{name}.id") == done["id"], "left").select("k", name, F.col("done").isNull().alias(f"open_{name}"))

    left, right = open_(one, "p"), open_(two, "q").withColumnRenamed("k", "k2")
    after = F.struct("p.first", "p.id") > F.struct("q.first", "q.id")
    met = left.join(right, (F.col("k") == F.col("k2")) & (F.col("p.id") != F.col("q.id")) & F.when(after, F.col("open_p")).otherwise(F.col("open_q")) & alike("p", "q"))
    a, b = F.when(after, F.col("p.node")).otherwise(F.col("q.node")), F.when(after, F.col("q.node")).otherwise(F.col("p.node"))
    found = written(settled.union(verified(met.select(a.alias("a"), b.alias("b")).distinct())).distinct(), "near")
    for used in (probe, index, texts, settled):
        discard(used)
    return found


def row_number(key: Column, text: Column) -> Column:
    """One number in the order of key (a long, null last) and a hash of the text; unlike a struct's, its least is found without sorting."""
    mark = F.shiftrightunsigned(F.xxhash64(text), 2).cast("decimal(19,0)")
    return F.coalesce(key.cast("long").cast("decimal(19,0)") * F.lit(Decimal(1 << 62)), F.lit(Decimal(5 * 10**37))) + mark


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed") -> DataFrame:
    """All columns of docs with repeated and nearly repeated lines taken out of text, and removed (array of line numbers from 0).

    Rows come in the order of key (null last) and a hash of the text. A line (what stands between \\n) goes if an
    equal line stands in an earlier row or earlier in its own, or if a near line (see above) first
    appears earlier (in the same row: has the smaller hash). Lines of white space alone always stay. Null texts
    stay null, empty ones empty. Rows of equal key but different texts, or of null keys, are documents of their
    own; rows that repeat key and text are one document, so all of them keep the same lines. A column named as
    removed is replaced. No rows give no rows.
    """
    row = row_number(docs[key], docs[text])
    # made once a row: beside the explosion it would be made again for every line
    spots = docs.select(row.alias("row"), docs[text].alias("text")).select("row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    mark = F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    grouped = spots.groupBy("line").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("times"))
    lines = written(grouped.sortWithinPartitions("line").select(F.monotonically_increasing_id().alias("id"), "line", word_number(F.col("line")).alias("words"), "first", "times"), "lines")
    near = near_lines(lines).withColumn("near", F.lit(True))
    repeated = lines.join(near, "id", "left").filter("times > 1 or near").select(mark.alias("mark"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    repeated = written(repeated, "repeated")
    discard(lines)
    hits = spots.select("row", "pos", mark.alias("mark")).join(repeated, "mark").withColumnRenamed("mark", "id")
    own = ~F.col("near") & F.coalesce(F.col("first") == F.col("row"), F.lit(False))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("id", "pos", own.alias("own")))).alias("found"))

    def out(all_: Column) -> Column:
        """Of a line's own first row the first occurrence stays."""
        gone = F.filter(all_, lambda x, i: ~x["own"] | F.coalesce(F.get(all_, i - 1)["id"] == x["id"], F.lit(False)))
        return F.array_sort(F.transform(gone, lambda x: x["pos"]))

    gone = found.select("row", F.transform(F.array("found"), out)[0].alias("gone")).filter(F.size("gone") > 0)
    names = [c for c in docs.columns if c != removed]
    tagged = docs.select(F.struct(*(docs[c] for c in names)).alias("all"), row.alias("row")).join(gone, "row", "left")
    lost, whole = F.col("gone"), F.split(F.col("all")[text], "\n")
    # runs of lines that stay, each followed by one that goes; array_join passes over nulls
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), lost), F.concat(lost, F.array(F.size(whole))), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False))))
    kept = F.array_join(F.zip_with(whole, F.flatten(runs), lambda line, stays: F.when(stays, line)), "\n")
    fields = [(F.when(lost.isNull(), F.col("all")[c]).otherwise(kept) if c == text else F.col("all")[c]).alias(c) for c in names]
    return tagged.select(*fields, F.coalesce(lost, F.array().cast("array<int>")).alias(removed))
