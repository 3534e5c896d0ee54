"""The comparison with the reference corpus against a plain re-computation, document by document."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from folioscope.functions import profiles
from folioscope.plans import catalog

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
LOOK = dict(zip(profiles.CYR_LOOK, profiles.LAT_LOOK, strict=True))
BACK = dict(zip(profiles.LAT_BACK, profiles.CYR_BACK, strict=True))
LETTERS = dict(zip(*profiles.TRANSLIT_ONE, strict=True)) | dict(profiles.TRANSLIT_MANY)


def shown(text):
    return "".join("'" if c in profiles.APOSTROPHES else c for c in text if c not in profiles.INVISIBLE)


def canonical(word):
    latin, cyrillic = sum(c.isascii() and c.isalpha() for c in word), sum("Ѐ" <= c <= "ӿ" for c in word)
    if cyrillic and latin:
        word = "".join((BACK if cyrillic >= latin else LOOK).get(c, c) for c in word)
    return "".join(LETTERS.get(c, c) for c in word.lower())


STOP = {canonical(shown(w)) for words in profiles.STOP.values() for w in words}
PHRASES = [p for p in (tuple(canonical(w) for w in WORD.findall(shown(x))) for x in profiles.TEMPLATES_UZ + profiles.TEMPLATES_RU + profiles.TEMPLATES_EN) if len(p) > 1]


def stream(text):
    """(word, quoted, cited) of all words; references and formulas are left out."""
    out, references = [], False
    for line in filter(None, (x.strip(" ") for x in text.split("\n"))):
        line = shown(line)
        if re.match(r"^(references|список литературы)$", line.lower()):
            references = True
        elif re.match(r"^\d+\. [A-Z][^.!?]*$", line):
            references = False
        if references or re.match(r"^[\w ]{1,3}= ?[\d+*()x=^ ]+$", line):
            continue
        quotes = []
        for m in re.finditer(r"«[^«»]{12,1500}»|\"[^\"]{12,1500}\"", line):
            quotes.append((m.start(), m.end(), bool(re.match(r"^\s*[,.;:]?\s*(\[\s*\d+[^\]]{0,30}\]|\([^()]{0,80}?(19|20)\d{2}[a-z]?[^()]{0,20}\))", line[m.end() :]))))
        for m in WORD.finditer(line):
            inside = [q for q in quotes if q[0] <= m.start() < q[1]]
            out.append((canonical(m[0]), bool(inside), bool(inside and inside[0][2])))
    return out


def shingles(words):
    grams = [(i, words[i : i + 6]) for i in range(len(words) - 5)]
    return [(i, int(hashlib.md5(" ".join(g).encode()).hexdigest()[:15], 16)) for i, g in grams if sum(w not in STOP and len(w) > 1 for w in g) >= 2]


def winnowed(found):
    if len(found) <= 4:
        return set(found)
    return {min(found[i : i + 4], key=lambda x: (x[1], -x[0])) for i in range(len(found) - 3)}


def expected(docs, refs):
    postings = defaultdict(list)
    for ref, text in sorted(refs):
        for pos, h in winnowed(shingles([w for w, _, _ in stream(text.replace("\n", " "))])):
            postings[h].append((ref, pos))
    for h in postings:
        postings[h] = sorted(postings[h])[:40]
    out = {}
    for doc, text in docs:
        tokens = stream(text or "")
        words, cited = [t[0] for t in tokens], [t[2] for t in tokens]
        hits = defaultdict(list)
        for pos, h in shingles(words):
            for ref, _ in postings.get(h, ()):
                hits[ref].append(pos)
        stock = set()
        for i in range(len(words)):
            fits = [p for p in PHRASES if tuple(words[i : i + len(p)]) == p]
            if fits:
                stock |= set(range(i, i + max(map(len, fits))))
        cover = {ref: {p + o for p in at for o in range(6)} - stock for ref, at in hits.items() if len(at) >= 2}
        cover = {ref: c for ref, c in cover.items() if len(c) >= 12}
        matched = set().union(*cover.values()) if cover else set()
        citation = {i for i, t in enumerate(tokens) if t[2] or t[1] and i in matched}
        b, c = (round(100 * len(x) / max(1, len(words)), 2) for x in (matched - citation, citation))
        out[doc] = (len(words), len(matched - citation), len(citation), len(cover), b, c, round(max(0, 100 - b - c), 2))
        assert sum(cited) <= len(citation)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, base = random.Random(3), tmp_path_factory.mktemp("tables")
    vocabulary = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice([*vocabulary, "the", "of", "and"]) for _ in range(n))

    refs = [(i, prose(60)) for i in range(12)] + [(20 + i, "a passage that many references hold alike and that goes on for some more words still, until enough of its words have been copied into another document") for i in range(50)]
    some = [t for _, t in refs[:12]]
    part = lambda i, a, b: " ".join(some[i].split()[a:b])
    cyrillic = str.maketrans("aeopcx", "аеорсх")
    docs = [
        (1, f"{prose(30)}\n{part(0, 5, 45)}\n{prose(20)}"),
        (2, f"{prose(10)} «{part(1, 0, 30)}» [3] {prose(30)}"),
        (3, f"{prose(10)} «{part(2, 0, 30)}» {prose(30)}"),
        (4, f"{prose(10)} \"{prose(12)}\" (Smith, 2001). {prose(30)}"),
        (5, part(3, 0, 40).translate(cyrillic)),
        (6, "​".join(part(4, 0, 40))),
        (7, f"{part(5, 0, 20)}\nx = 12 + 3 * (4 + x)\n{part(5, 20, 40)}\nReferences\n{part(6, 0, 50)}\n2. After that\n{part(7, 0, 13)}"),
        (8, f"{part(8, 0, 9)} it should be noted that {part(8, 9, 60)}"),
        (9, refs[-1][1]),
        (10, f"{part(9, 0, 30)} {part(10, 0, 30)} {part(9, 25, 60)}"),
        (11, "in conclusion at the same time in recent years it should be noted that"),
        (12, None),
        (13, ""),
        (14, f"{part(11, 0, 10)} {prose(5)}"),
    ]
    spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(refs, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), docs, refs


def test_originality_equals_a_plain_computation(spark, tables):
    base, docs, refs = tables
    got = {r.doc_id: (r.words, r.borrowed_words, r.cited_words, r.n_sources, r.borrowing, r.citation, r.originality) for r in catalog.QUERIES["k7_originality"](spark, base).collect()}
    assert got == expected(docs, refs)
    assert got[1][1] > 30 and got[2][2] >= 30 and got[3][2] >= 25 and got[5][1] > 0 and got[6][0] and got[9][3] == 40 and got[11][1] == got[14][1] == 0


def test_classes_and_spans_add_up(spark, tables):
    base, docs, _ = tables
    whole = {r.doc_id: r for r in catalog.QUERIES["k7_originality"](spark, base).collect()}
    classes = defaultdict(dict)
    for r in catalog.QUERIES["k2_word_classes"](spark, base).collect():
        classes[r.doc_id][r.cls] = r.words
    spans = defaultdict(int)
    for r in catalog.QUERIES["k5_spans"](spark, base).filter("cls = 'b'").collect():
        spans[r.doc_id] += r.words
    for doc, r in whole.items():
        assert classes[doc].get("borrowed", 0) == r.borrowed_words == spans[doc] and classes[doc].get("citation", 0) == r.cited_words
