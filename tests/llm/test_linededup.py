"""Line de-duplication against brute force: every pair of lines, every document, odd rows."""

import random
import zlib

from pyspark.sql import functions as F

from folioscope.llm import linededup

SCHEMA = "doc_id long, text string, removed string, found string, pos int"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def allowed(mode, n):
    return max([t for least, t in linededup.STEPS[mode] if n >= least], default=0)


def near(a, b):
    x, y = a.split(" "), b.split(" ")
    if max(len(x), len(y)) <= linededup.WORDS + 1 and distance(a, b) <= allowed("chars", min(len(a), len(b))):
        return True
    return min(len(x), len(y)) >= linededup.WORDS and distance(x, y) <= allowed("words", min(len(x), len(y)))


def edited(rng, symbols, edits):
    u = list(symbols)
    for _ in range(edits):
        at = rng.randint(0, len(u))
        u[at : at + rng.randint(0, 1)] = rng.choice([[], [f"z{rng.randint(0, 9)}"]])
    return u


def families():
    """Lines of all lengths with edits in words and in characters."""
    rng, lines = random.Random(11), set()
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    for n in (1, 2, 3, 5, 6, 7, 8, 9, 10, 12, 20, 39, 40, 41, 60, 79, 80, 82, 120):
        for _ in range(2):
            base = [rng.choice(words) for _ in range(n)]
            lines.add(" ".join(base))
            for edits in (1, 1, 2, 2, 3, 4):
                lines.add(" ".join(edited(rng, base, edits)))
                lines.add("".join(c[0] for c in edited(rng, " ".join(base), min(edits, 3)) if c))
    return sorted(x for x in lines if x.strip())


def test_bit_parallel_distance(spark):
    rng = random.Random(10)
    pairs = set()
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 9))]
        pairs.add(("".join(a), "".join(edited(rng, a or ["q"], rng.randint(0, 5))), rng.randint(0, 3)))
    df = spark.createDataFrame(sorted(pairs), "a string, b string, t int")
    symbols = [F.filter(F.split(x, ""), lambda c: c != "") for x in ("a", "b")]
    got = {tuple(r) for r in df.filter(linededup.distance_within(*symbols, F.col("t"))).collect()}
    assert got == {p for p in pairs if distance(p[0], p[1]) <= p[2]}


def test_join_finds_every_later_near_line(spark):
    lines = families()
    order = {x: zlib.crc32(x.encode()) for x in lines}
    df = spark.createDataFrame([(i, x, order[x]) for i, x in enumerate(lines)], "id long, line string, first long")
    got = {r.id for r in linededup.near_lines(df.withColumn("words", linededup.word_number(F.col("line")))).collect()}
    want = {i for i, x in enumerate(lines) for j, y in enumerate(lines) if i != j and (order[y], j) < (order[x], i) and near(x, y)}
    assert got == want and 50 < len(want) < len(lines) - 30


def test_a_group_of_like_lines_far_from_its_oldest(spark):
    """What the oldest line of a bucket does not settle is compared with all others."""
    words = [f"w{i}" for i in range(30)]
    lines = [" ".join(words), " ".join([*words[:20], "a", "b", "c", *words[23:]]), " ".join([*words[:20], "a", "b", "d", *words[23:]]), " ".join([*words[:19], "e", "f", "g", *words[22:]])]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(lines)], "id long, line string, first int")
    assert [r.id for r in linededup.near_lines(df.withColumn("words", linededup.word_number(F.col("line")))).collect()] == [2]


def brute(data):
    """(key, text, kept text, removed) of every row by comparing every line with all before it."""
    ordered = sorted({(d is None, d or 0, t) for d, t in data if t is not None}, key=lambda r: r[:2])
    assert len({r[:2] for r in ordered}) == len(ordered), "ties of the key need the engine's hash"
    firsts, out = {}, {}
    for n, d, t in ordered:
        gone = []
        for at, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\x0b\x0c\r") and line in firsts:
                gone.append(at)
            elif line.strip(" \t\n\x0b\x0c\r"):
                firsts[line] = (n, d)
        out[n, d] = [gone, t]
    for n, d, t in ordered:
        for at, line in enumerate(t.split("\n")):
            if any(near(line, x) and f < (n, d) and firsts.get(line) == (n, d) for x, f in firsts.items() if x != line):
                out[n, d][0].append(at)
    return {k: (sorted(set(g)), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)) for k, (g, t) in out.items()}


def test_documents_equal_brute_force(spark):
    rng, lines = random.Random(14), families()
    data = [(i, "\n".join(rng.choice([*rng.sample(lines, 3), "", "  "]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    # near lines that share their first row would be ordered by the engine's hash: keep one of them
    data = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if not any(near(x, y) for y in t.split("\n")[:n] if y != x))) for i, t in data]
    data.append((None, "\n".join(rng.sample(lines, 12)[:1])))
    df = spark.createDataFrame([(d, t, "clash", "x", 1) for d, t in data] + [(999, None, "clash", None, None)], SCHEMA)
    got = linededup.dedup(df).collect()
    want = brute(data)
    assert len(got) == len(data) + 1 and all((r.removed, r.text) == want[r.doc_id is None, r.doc_id or 0] for r in got if r.text is not None)
    assert [r.text for r in got if r.doc_id == 999] == [None] and df.columns[:2] == ["doc_id", "text"]
    assert sum(len(r.removed) for r in got) > 50


def test_rows_of_one_key_or_of_none_are_documents_of_their_own(spark):
    old, own = "an old line that the first document has", "a line that occurs here and nowhere else at all"
    data = [(1, old), (5, f"x1 {own}\n{old}"), (5, f"{own} of mine\nsomething quite unlike what came before"), (None, f"{old}\nfirst without a key"), (None, "second without a key\nand a line")]
    got = {r.text for r in linededup.dedup(spark.createDataFrame([(*d, None, None, None) for d in data], SCHEMA)).collect()}
    assert got == {old, f"x1 {own}", data[2][1], "first without a key", data[4][1]}


def test_rows_are_numbered_in_their_order(spark):
    keys = [-(1 << 63), -(1 << 63) + 1, -7, -1, 0, 1, 5, (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, k, t) for i, k in enumerate(keys) for t in ("", "a", "b b", None)], "i int, k long, t string")
    got = sorted((r.n, r.i) for r in df.select("i", linededup.row_number(F.col("k"), F.col("t")).alias("n")).collect())
    assert [i for _, i in got] == sorted(i for _, i in got) and len({n for n, _ in got}) == len(got)


def test_lines_are_grouped_without_sorting(spark):
    """A line's first row is found by hashing; a least struct would have the texts of the lines sorted."""
    docs = spark.createDataFrame([(1, "some line\nother line")], "doc_id long, text string")
    plan = docs.select(linededup.row_number(F.col("doc_id"), F.col("text")).alias("row"), "text").groupBy("text").agg(F.min("row"), F.count(F.lit(1)))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_keep_the_same_lines(spark):
    data = [(2, "some words here\nsome words here\n \nend"), (2, "some words here\nsome words here\n \nend"), (3, "end\nEND"), (4, ""), (5, None)]
    got = sorted((r.doc_id, r.text, r.removed) for r in linededup.dedup(spark.createDataFrame([(*d, None, None, None) for d in data], SCHEMA)).filter("text is not null").collect())
    assert got == [(2, "some words here\n \nend", [1])] * 2 + [(3, "END", [0]), (4, "", [])]
    assert linededup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_document(spark):
    rng = random.Random(15)
    long_ = "\n".join(rng.choice(["yes", "no", "", f"line {i} of a very long document"]) for i in range(30_000))
    got = linededup.dedup(spark.createDataFrame([(1, long_, None, None, None), (2, "x" * 200_000, None, None, None)], SCHEMA)).orderBy("doc_id").collect()
    lines = got[0].text.split("\n")
    assert got[1].text == "x" * 200_000 and lines.count("yes") == lines.count("no") == 1 and lines.count("") == long_.split("\n").count("")
