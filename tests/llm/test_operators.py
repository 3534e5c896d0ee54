"""Each training-data operator against brute force on small tables with nulls, ties, repeats and odd rows."""

import math
import random
import time
from collections import Counter

import numpy as np
import xxhash
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ann, bpe, chat, fingerprint, html, minhash, mixing, pylm, toxicity
from folioscope.llm.common import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows(*texts):
    return [(i, t, "en", ["a", "b", None][i % 3], None, "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))) for _ in range(40)]
    near = [t.split() for t in out[:15]]
    for t in near:
        t[rng.randrange(len(t))] = "changed"
    return [*out, *(" ".join(t) for t in near), out[3], out[3], None, "", " \n\t ", "é" * 3000 + " Ünï   🙂", "word " * 5000, "one", "one two"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*rows(*texts), (None, "no key here at all", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 ------------------------------------------------------------------------------------------------
def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(1)
    x[50:80] = x[7]
    data = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)]
    data += [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] + [1.0] * 7, "x"), (903, [None] + [1.0] * 7, "x"), (904, [1.0, 2.0], "x"), (None, [1.0] * 8, "x"), (5, [float(v) for v in x[5]], "x")]
    got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, score string"), lambda k: k % 20 == 0, k=20).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(mine) == set(range(0, 300, 20))
    for q, found in mine.items():
        score = np.cumsum(x * x[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        assert [v for _, v, _ in sorted(found)] == order and [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert np.allclose([s for _, _, s in sorted(found)], score[order], atol=0)


def test_nearest_of_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.nearest(spark.createDataFrame([], schema), lambda k: k % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), lambda k: k % 20 == 0).collect()[0].vec_id == 1


# 2 ------------------------------------------------------------------------------------------------
def test_language_model_counts_and_base(docs, texts):
    got = {r.doc_id: r for r in pylm.score(docs, F.coalesce(F.col("doc_id") % 5 != 2, F.lit(True))).collect()}
    assert len(got) == len(texts) + 1
    tokens = {i: [*words(t), b" "] for i, t in enumerate(texts)} | {None: [*words("no key here at all"), b" "]}
    counts = Counter(w for i, ws in tokens.items() if i is None or i % 5 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (i is not None and i % 5 == 2)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    pair_word, pair_context = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(6), indexing="ij"))
    heavy = np.arange(100, 106, dtype=np.uint64)
    counts = {"word": np.arange(30, dtype=np.uint64), "context": heavy, "pair_word": pair_word, "pair_context": pair_context, "c": rng.integers(0, 300, 180)}

    def totals(s):
        context_c, context_t = (np.bincount(s.pair_context, x, 6) for x in (s.c, s.tables))
        return {"context_c": context_c, "context_t": context_t, "heavy_c": np.zeros(6), "heavy_t": np.zeros(6), "root_c": s.root_c.sum(), "root_t": s.root_t.sum(), "vocabulary": 30}

    s = pylm.Seating(0, counts, heavy)
    for number in range(3):
        s.sweep(number, totals(s))
    t = totals(s)
    p = s.predictive(3, t)
    unknown = (pylm.THETA0 + pylm.D0 * t["root_t"]) / 31 / (pylm.THETA0 + t["root_c"])
    for c in range(6):
        rest = (pylm.THETA1 + pylm.D1 * t["context_t"][c]) * unknown / (pylm.THETA1 + t["context_c"][c])
        assert math.isclose(p[s.pair_context == c].sum() + rest, 1, rel_tol=1e-9)


def test_totals_of_contexts_over_parts(spark, docs, texts):
    """Every part learns how often each of its contexts occurs anywhere, and how many tables it has after every sweep."""
    heavy = np.unique(np.array([pylm.BEGIN, pylm.END, *(xxhash.xxh3_64_intdigest(w) for w in words(texts[0])[:3])], np.uint64))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text", F.lit(True).alias("train"))
    chain = pylm.Chain(pylm._gather(pylm._route(rows, heavy, 3), heavy), heavy, 3)
    true = Counter()
    for text in [*texts, "no key here at all"]:
        h, context = pylm._tokens(text)
        true.update(zip(h.tolist(), context.tolist(), strict=True))
    context_c = Counter()
    for (_, context), c in true.items():
        context_c[context] += c
    for done in range(3):
        chain.sweep()
        seated, tables = [], Counter()
        for r in chain.rows("counts").collect():
            s = pylm.Seating(r.part, pylm._unpack(r.counts), heavy, [tuple(x) for x in r.replies or ()])
            for number in range(done):
                s.sweep(number, chain.history[number])
            for context, t in zip(s.context[s.pair_context].tolist(), s.tables.tolist(), strict=True):
                tables[context] += t
            seated.append(s)
        pairs = Counter()
        for s in seated:
            s.see(done, chain.history[done])
            used = np.unique(s.pair_context)
            assert [context_c[c] for c in s.context[used].tolist()] == s.context_c[used].tolist()
            assert [tables[c] for c in s.context[used].tolist()] == s.context_t[used].tolist()
            pairs.update(dict(zip(zip(s.word[s.pair_word].tolist(), s.context[s.pair_context].tolist(), strict=True), s.c.tolist(), strict=True)))
        assert pairs == true
        assert chain.history[done]["root_c"] == sum(tables.values())
        assert chain.history[done]["vocabulary"] == len({w for w, _ in true})


def test_tokens_take_few_bytes_in_small_pieces(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    data = [(i, " ".join(rng.choice(vocabulary) for _ in range(100)), True) for i in range(1000)]
    rows = spark.createDataFrame(data, "key long, text string, train boolean").coalesce(1)
    heavy = np.unique(np.array([pylm.BEGIN, pylm.END], np.uint64))
    assert pylm._route(rows, heavy, 50).agg(F.sum(F.octet_length("data"))).first()[0] / 100_000 < 10


def test_packed_arrays_come_back():
    rng = np.random.default_rng(22)
    some = {"a": np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64) * 2), "b": rng.integers(-5, 500, 50), "c": rng.random(7), "d": np.zeros(0, np.uint32), "e": rng.random(9) < 0.5, "f": np.array([3, 70_000, 5])}
    back = pylm._unpack(pylm._pack(**some))
    assert list(back) == list(some) and all(back[k].dtype == x.dtype and (back[k] == x).all() for k, x in some.items())


def test_seats_of_a_sweep_are_kept(spark, docs):
    """A part that gets its seats of the sweeps before has the tables that these sweeps, done again, would give."""
    heavy = np.unique(np.array([pylm.BEGIN, pylm.END, xxhash.xxh3_64_intdigest(b"no")], np.uint64))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text", F.lit(True).alias("train"))
    chain = pylm.Chain(pylm._gather(pylm._route(rows, heavy, 2), heavy), heavy, 2)
    for _ in range(3):
        chain.sweep()
    for r in chain.rows("counts").collect():
        replies = [tuple(x) for x in r.replies]
        assert {i for i, owner, _ in replies if owner < 0} == {0, 1}
        kept, again = (pylm.Seating(r.part, pylm._unpack(r.counts), heavy, [x for x in replies if x[1] >= 0 or with_]) for with_ in (True, False))
        for number in range(2):
            for s in (kept, again):
                s.sweep(number, chain.history[number])
            assert (kept.tables == again.tables).all() and (kept.root_c == again.root_c).all() and (kept.root_t == again.root_t).all()


def test_seating_matches_one_by_one():
    rng, d, a, c = np.random.default_rng(3), 0.5, 2.0, 400
    fast = pylm.seat(np.full(3000, c), np.full(3000, a), d, rng)
    slow = []
    for _ in range(300):
        t = 1
        for i in range(1, c):
            t += rng.random() < a / (a + i - d * t)
        slow.append(t)
    assert abs(fast.mean() - np.mean(slow)) < 0.6 and (fast >= 1).all() and (fast <= c).all()


def test_language_model_of_nothing(empty):
    assert pylm.score(empty, F.lit(True)).count() == 0


# 3 ------------------------------------------------------------------------------------------------
def test_toxicity_separates(spark, empty):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    bad = ["awfulword", "horridterm", "nastything", "vileremark"]
    data, labels = [], []
    for i in range(600):
        t = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(5):
                t[rng.randrange(60)] = rng.choice(bad)
        data.append((i, " ".join(t), None, None, None, None, None))
        labels.append((i, int(i % 4 == 0), 0))
    data += [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (None, "abc", None, None, None, None, None)]
    docs, labels = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    held = [i for i in range(600) if i % 3 == 2]
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.learn(docs, labels.limit(0), F.lit(True)).shares[0] == 0.0


def test_both_dictionaries_are_trained_on_few_texts():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(90)]
    model = toxicity.fit([f"{x} nastything vileremark {x}" for x in plain[:30]], plain[30:], 0.3)
    magic = b"\x37\xa4\x30\xec"
    assert model.toxic.startswith(magic) and model.ordinary.startswith(magic)
    assert sum(w.encode() in model.ordinary for w in vocabulary) > 30 and b"nastything" in model.toxic


# 4 ------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(docs, empty, texts):
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].decoded == (t or "") and got[i].n_tokens == len(want)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pairs_by_halves_equal_plain_merges():
    with open(RANKS, "rb") as f:
        machine = bpe.MergeTransducer(bpe.parse_ranks(f.read()))
    rng = random.Random(6)
    for _ in range(3000):
        a, b = rng.randrange(5000), rng.randrange(5000)
        if machine.merged(machine.spelling[a]) == [a] and machine.merged(machine.spelling[b]) == [b]:
            assert machine.may_follow(a, b) == (machine.merged(machine.spelling[a] + machine.spelling[b]) == [a, b])


def test_long_pieces_are_settled_on_the_way():
    with open(RANKS, "rb") as f:
        machine = bpe.MergeTransducer(bpe.parse_ranks(f.read()))
    machine.STRIDE = 64
    piece = bytes(random.Random(7).choice(b"abetn ") for _ in range(1500))
    assert machine.encode(piece) == machine.merged(piece)


def test_utf8_machine_at_every_cut():
    data = "aé€🙂z".encode() + b"\xff\xe2\x82"
    for cut in range(len(data) + 1):
        m = bpe.Utf8Decoder()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.close() == data.decode("utf-8", "replace")


# 5 ------------------------------------------------------------------------------------------------
def test_near_duplicates_equal_brute_force(docs, empty, texts):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, k=4).collect()}
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), label[i], label[i] == i)
    assert got[None].kept and minhash.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        n = int(400 * share)
        other = np.concatenate([base[:n], rng.integers(0, 2**63, 400 - n).astype(np.uint64)])
        assert abs((minhash.sketch(base) == minhash.sketch(other)).mean() - n / (800 - n)) < 0.16
    assert len(minhash.sketch(base[:1])) == minhash.BINS


def test_wide_groups_lose_no_link(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"x{rng.random()}"
        data.append(" ".join(t))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows(*data), SCHEMA), k=4).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in data]
    label = list(range(120))
    changed = True
    while changed:
        changed = False
        for i in range(120):
            for j in range(i):
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert [got[i] for i in range(120)] == label


# 6 ------------------------------------------------------------------------------------------------
def test_branches_are_ranked_and_read_back(spark):
    nodes = [(1, 1, None, "user", "hi [INST] </s> \\ x", 0.0), (1, 2, 1, "assistant", "a\\", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", None, 9.0), (None, 7, None, "user", "", None), (2, 1, 99, "odd[/ROLE]role", "orphan", 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.branch): r for r in chat.format_trees(df).collect()}
    assert [got[1, b].leaf for b in (1, 2)] == [4, 3] and (None, 1) in got and (2, 1) in got
    back = {(r.tree, r.leaf): r for r in chat.read_back(chat.format_trees(df, top=1)).collect()}
    assert [(t.role, t.text) for t in back[1, 4].turns] == [("user", "hi [INST] </s> \\ x"), ("assistant", "a\\"), ("user", "")]
    assert back[1, 4].loss_text == "a\\" and back[2, 1].turns[0].role == "odd[/ROLE]role"


def test_chains_of_any_length(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(37)] + [(None, None, None, None), (1, 5, "user", "t5")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.read_back(chat.format_trees(chat.chain(df))).collect()}
    assert len(got[1].turns) == 38 and got[1].loss_text == "".join(f"t{i}" for i in range(0, 37, 2)) and len(got[None].turns) == 1
    assert chat.format_trees(chat.chain(df.limit(0))).count() == 0


@pytest.mark.parametrize("rows_", [[("t", 1, 2), ("t", 2, 1), ("t", 3, 1)], [("t", 1, 2), ("t", 2, 1), ("u", 3, None)]])
def test_circles_are_refused(spark, rows_):
    df = spark.createDataFrame(rows_, "tkey string, node long, parent long")
    with pytest.raises(ValueError):
        chat.paths(df)


def test_a_tree_named_null_and_the_null_tree_stay_apart(spark):
    nodes = [("null", 1, None, "user", "a", 0.0), (None, 1, None, "user", "b", 0.0), ("", 1, None, "user", "c", 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {r.tree: [t.text for t in r.turns] for r in chat.read_back(chat.format_trees(df)).collect()}
    assert got == {"null": ["a"], None: ["b"], "": ["c"]}


def test_paths_equal_an_enumeration(spark):
    rng = random.Random(16)
    parent = {(t, n): (rng.randrange(n) if n and rng.random() < 0.9 else None) for t in range(4) for n in range(25)}
    nodes = [(t, n, p, "user" if n % 2 else "assistant", f"{t}.{n}", float(n % 5)) for (t, n), p in parent.items()]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    want = {}
    for t, n in parent:
        if (t, n) not in {(a, p) for (a, _), p in parent.items()}:
            way = [n]
            while parent[t, way[-1]] is not None:
                way.append(parent[t, way[-1]])
            want[t, n] = ([f"{t}.{x}" for x in way[::-1]], float(sum(x % 5 for x in way)))
    got = chat.format_trees(df)
    back = {(r.tree, r.leaf): [x.text for x in r.turns] for r in chat.read_back(got).collect()}
    assert back == {k: v[0] for k, v in want.items()}
    order = sorted(want, key=lambda k: (k[0], -want[k][1], k[1]))
    assert [(r.tree, r.leaf) for r in sorted(got.collect(), key=lambda r: (r.tree, r.branch))] == order


# 7 ------------------------------------------------------------------------------------------------
def test_pages(spark):
    page = "<html><head><title>t</title></head><p>a<p>b &amp; c<ul><li>x<li>y<ol start=3><li>q</ol></ul><table><tr><td>one<td>2<tr><th>three<td>44</table><div hidden>no</div><script>'</p>'</script><pre>  k\n   v</pre>tail<br>more</b>"
    assert html.render(page) == "a\n\nb & c\n\n- x\n- y\n  3. q\n\none   | 2\nthree | 44\n\n  k\n   v\n\ntail\nmore"
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    df = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, deep, "u"), (None, "<p>x", "u"), (1, page, "u")], "page_id long, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 6 and Counter(r.text for r in got)["core"] == 1 and sum(r.text == "" for r in got) == 2
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title>Hello <b>world</b>", "Hello world"),
        ('<p class="btn hidden md">a</p><p title="the hidden truth">b</p><p data-hidden=1>c</p><p hidden>d</p><p HIDDEN="">e</p>', "a\n\nb\n\nc"),
        ('<div style="display : NONE">a</div><div style="visibility:hidden">b<i style="visibility:visible">c</i>d</div><div aria-hidden="true">e</div>', "c\ne"),
        ("<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>y<tr><td rowspan=2>r<td>1<td>z<tr><td>2<td>w</table>", "wide cell here | x\na | b          | y\nr | 1          | z\n  | 2          | w"),
        ("<p>before<table>loose<tr><td>in</table>after", "before\n\nloose\nin\n\nafter"),
        ("<svg><title>no</title><text>shown</text></svg> <math><mi>x</mi></math>", "shown x"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("a < b &amp; c <input type=hidden value=x><input type='text'>", "a < b & c"),
    ],
)
def test_what_is_visible(page, text):
    assert html.render(page) == text


def test_deep_pages_take_linear_time():
    began = time.time()
    assert html.render("<div>" * 20_000 + "core" + "</div>" * 20_000) == "core"
    assert html.render("<table><tr><td>" * 1000 + "core") == "core" and html.render("<b>" * 30_000 + "x" + "<p>y" * 3000).startswith("x")
    assert time.time() - began < 5


# 9 ------------------------------------------------------------------------------------------------
def test_fingerprints(docs, empty, texts):
    got = {r.doc_id: r for r in fingerprint.compare_edited(docs).collect()}
    order = [(None, "no key here at all"), *((i, t or "") for i, t in enumerate(texts))]
    errors = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert r.edited == new and r.n_chars == len(t)
        a, b = Counter(words(t)), Counter(words(new))
        if a and b:
            errors.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    same = {}
    for i, t in order:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert fingerprint.compare_edited(empty).count() == 0
    assert {r.fingerprint for r in fingerprint.fingerprints(docs).filter("doc_id = 3").collect()} == {got[3].fingerprint}


# 10 -----------------------------------------------------------------------------------------------
def test_mix_meets_targets(docs, empty, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) + 1
    size = Counter()
    for r in got:
        size[r.source] += r.size
    total, weight = sum(size.values()), dict(zip(["a", "b", None], [5, 2, 1], strict=True))
    capped, target = set(), {}
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in weight if s not in capped)
        over = {s for s in weight if s not in capped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * size[s] if s in capped else weight[s] * level for s in weight}
    taken, largest = Counter(), Counter()
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
        taken[r.source] += r.copies * r.size
    # a source whose words are mostly one document can only take it whole
    assert all(abs(taken[s] - target[s]) <= max(6, 0.01 * target[s], largest[s] / 2 if largest[s] > 0.5 * size[s] else 0) for s in weight)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs).collect())) and mixing.mix(empty).count() == 0


