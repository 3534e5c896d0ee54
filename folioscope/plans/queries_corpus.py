"""Matching against a reference corpus, originality, copies, and corpus upkeep."""

from __future__ import annotations

from folioscope.functions import profiles
from folioscope.operators.canonical import canonical_word
from folioscope.plans.dialect import Dialect

SHARED: dict = {}


def canonical_stop() -> list[str]:
    """Stop words of all languages, as canonical words."""
    return sorted({canonical_word(w) for words in profiles.STOP.values() for w in words})


def q(name: str, *bases: str):
    def add(build):
        SHARED[name] = (bases, build)
        return build

    return add


def template_words(d: Dialect, tokens: str = "ctok") -> str:
    """doc_id, pos, n of every place where a stock phrase of n words starts, the longest there."""
    phrases = {tuple(canonical_word(w) for w in p.split()) for p in profiles.TEMPLATES_UZ + profiles.TEMPLATES_RU + profiles.TEMPLATES_EN}
    by_size: dict[int, list[str]] = {}
    for p in sorted(phrases):
        if len(p) > 1:
            by_size.setdefault(len(p), []).append(" ".join(p))
    sizes = sorted(by_size, reverse=True)
    leads = ", ".join(f"lead(word, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{i}" for i in range(1, sizes[0]))

    def found(n: int) -> str:
        gram = f"concat_ws(' ', {', '.join(['word', *(f'w{i}' for i in range(1, n))])})"
        return f"WHEN w{n - 1} IS NOT NULL AND {gram} IN ({', '.join(d.lit(p) for p in by_size[n])}) THEN {n}"

    firsts = ", ".join(d.lit(w) for w in sorted({p[0] for p in phrases}))
    return f"""SELECT doc_id, pos, n FROM (SELECT doc_id, pos, CASE {' '.join(found(n) for n in sizes)} END AS n FROM (SELECT doc_id, pos, word, {leads} FROM {d.t(tokens)}) y WHERE word IN ({firsts})) z WHERE n IS NOT NULL"""


def hits(d: Dialect) -> str:
    """CTEs of the comparison with the reference corpus.

    post: at most 40 postings a hash; hit: hits and their number a source; cover: words that sources of two hits cover, stock phrases
    taken out; kept: those of sources of twelve words; ranked: sources, most words outside citations first; word: every covered word
    once, with the best source that covers it and the class (b borrowed, c citation).
    """
    return f"""WITH post AS (SELECT doc_id AS ref, pos AS ref_pos, h FROM (SELECT doc_id, pos, h, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM {d.t('rfp')}) z WHERE k <= 40),
    hit AS (SELECT s.doc_id, p.ref, s.pos, p.ref_pos, count(*) OVER (PARTITION BY s.doc_id, p.ref) AS n_hits FROM {d.t('sh')} s JOIN post p ON s.h = p.h),
    raw AS (SELECT DISTINCT doc_id, ref, pos + o AS pos FROM (SELECT doc_id, ref, pos, {d.explode(d.series('0', '5'))} AS o FROM hit WHERE n_hits >= 2) z),
    stock AS (SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT doc_id, pos, {d.explode(d.series('0', 'n - 1'))} AS o FROM ({template_words(d)}) y) z),
    cover AS (SELECT r.doc_id, r.ref, r.pos, t.quoted OR t.cited AS citation FROM raw r JOIN {d.t('ctok')} t ON t.doc_id = r.doc_id AND t.pos = r.pos LEFT JOIN stock s ON s.doc_id = r.doc_id AND s.pos = r.pos WHERE s.pos IS NULL),
    kept AS (SELECT doc_id, ref, pos, citation, own FROM (SELECT doc_id, ref, pos, citation, count(*) OVER w AS n, sum(CASE WHEN citation THEN 0 ELSE 1 END) OVER w AS own FROM cover WINDOW w AS (PARTITION BY doc_id, ref)) z WHERE n >= 12),
    ranked AS (SELECT doc_id, ref, pos, citation, own, dense_rank() OVER (PARTITION BY doc_id ORDER BY own DESC, ref) AS rk FROM kept),
    word AS (SELECT doc_id, pos, min(rk) AS rk, max(CASE WHEN citation THEN 'c' ELSE 'b' END) AS cls FROM ranked GROUP BY doc_id, pos),
    total AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN cited THEN 1 ELSE 0 END) AS n_cited FROM {d.t('ctok')} GROUP BY doc_id)"""


MATCH = ("sh", "ctok", "rfp")


@q("d1_capped_hash_join", *MATCH)
def _(d):
    return hits(d) + " SELECT doc_id, ref, count(*) AS n_hits, min(pos) AS first_pos, max(ref_pos) AS last_ref_pos FROM hit GROUP BY doc_id, ref"


@q("d2_two_hit_sources", *MATCH)
def _(d):
    return hits(d) + f" SELECT g.doc_id, g.ref, g.n, b.text AS ref_text FROM (SELECT doc_id, ref, count(*) AS n FROM hit WHERE n_hits >= 2 GROUP BY doc_id, ref) g JOIN {d.t('benchmark')} b ON b.item_id = g.ref"


@q("h4_coverage", *MATCH)
def _(d):
    return hits(d) + " SELECT doc_id, ref, count(*) AS covered, min(pos) AS first_pos, max(pos) AS last_pos FROM raw GROUP BY doc_id, ref"


@q("c16_minimum_source_words", *MATCH)
def _(d):
    return hits(d) + " SELECT doc_id, ref, count(*) AS words FROM kept GROUP BY doc_id, ref"


def shares(of_all: str) -> str:
    """Borrowing, citation and originality in percent, the last from the rounded others."""
    b, c = (f"round(CAST(100 AS DOUBLE) * {x} / greatest(1, n), 2)" for x in ("borrowed", "cited"))
    return f"SELECT doc_id, words, borrowed_words, cited_words, n_sources, borrowing, citation, round(greatest(CAST(0 AS DOUBLE), 100 - borrowing - citation), 2) AS originality FROM (SELECT doc_id, n AS words, borrowed AS borrowed_words, cited AS cited_words, n_sources, {b} AS borrowing, {c} AS citation FROM ({of_all}) y) z"


@q("k7_originality", *MATCH)
def _(d):
    # a citation is what is quoted with a mark behind it, matched or not, and what is quoted and matched
    per = """, m AS (SELECT w.doc_id, sum(CASE WHEN cls = 'b' THEN 1 ELSE 0 END) AS borrowed, sum(CASE WHEN cls = 'c' AND NOT t.cited THEN 1 ELSE 0 END) AS quoted, max(s.n) AS n_sources
        FROM word w JOIN {ctok} t ON t.doc_id = w.doc_id AND t.pos = w.pos JOIN (SELECT doc_id, max(rk) AS n FROM ranked GROUP BY doc_id) s ON s.doc_id = w.doc_id GROUP BY w.doc_id) """
    each = f"SELECT x.doc_id, coalesce(t.n, 0) AS n, coalesce(m.borrowed, 0) AS borrowed, coalesce(t.n_cited, 0) + coalesce(m.quoted, 0) AS cited, coalesce(m.n_sources, 0) AS n_sources FROM {d.t('documents')} x LEFT JOIN total t ON t.doc_id = x.doc_id LEFT JOIN m ON m.doc_id = x.doc_id"
    return hits(d) + per.format(ctok=d.t("ctok")) + shares(each)


@q("e5_percentages", *MATCH)
def _(d):
    return hits(d) + ", c AS (SELECT doc_id, sum(CASE WHEN cls = 'b' THEN 1 ELSE 0 END) AS borrowed, sum(CASE WHEN cls = 'c' THEN 1 ELSE 0 END) AS cited FROM word GROUP BY doc_id) SELECT c.doc_id, round(CAST(100 AS DOUBLE) * borrowed / n, 2) AS borrowing, round(CAST(100 AS DOUBLE) * cited / n, 2) AS matched_citation FROM c JOIN total t ON t.doc_id = c.doc_id"


@q("k2_word_classes", *MATCH)
def _(d):
    return hits(d) + f""" SELECT t.doc_id, CASE WHEN t.cited OR w.cls = 'c' THEN 'citation' WHEN w.cls = 'b' THEN 'borrowed' ELSE 'original' END AS cls, count(*) AS words FROM {d.t('ctok')} t LEFT JOIN word w ON w.doc_id = t.doc_id AND w.pos = t.pos
    GROUP BY t.doc_id, CASE WHEN t.cited OR w.cls = 'c' THEN 'citation' WHEN w.cls = 'b' THEN 'borrowed' ELSE 'original' END"""


def source_shares(first: bool = True) -> str:
    """The first 60 sources of a document: words outside citations, and those that no better source has."""
    return (", " if first else "WITH ") + """o AS (SELECT doc_id, rk, count(*) AS own FROM (SELECT doc_id, pos, min(rk) AS rk FROM ranked WHERE NOT citation AND rk <= 60 GROUP BY doc_id, pos) z GROUP BY doc_id, rk), r AS (SELECT doc_id, ref, rk, max(own) AS words FROM ranked WHERE rk <= 60 GROUP BY doc_id, ref, rk)
    SELECT r.doc_id, r.ref, r.rk, r.words, coalesce(o.own, 0) AS own_words, round(CAST(100 AS DOUBLE) * r.words / greatest(1, t.n), 2) AS share_text, round(CAST(100 AS DOUBLE) * coalesce(o.own, 0) / greatest(1, t.n), 2) AS share_report
    FROM r JOIN total t ON t.doc_id = r.doc_id LEFT JOIN o ON o.doc_id = r.doc_id AND o.rk = r.rk"""


@q("k3_source_shares", *MATCH)
def _(d):
    return hits(d) + source_shares()


@q("e6_top_sources", *MATCH)
def _(d):
    return hits(d) + f" SELECT doc_id, count(*) AS n_sources, max(share_text) AS most, round(sum(share_report), 2) AS reported FROM ({source_shares(False)}) z GROUP BY doc_id"


@q("k4_citation_owners", *MATCH)
def _(d):
    return hits(d) + " SELECT doc_id, rk, count(*) AS words FROM word WHERE cls = 'c' AND rk <= 60 GROUP BY doc_id, rk"


@q("k5_spans", *MATCH)
def _(d):
    return hits(d) + f""", g AS (SELECT w.doc_id, t.idx, w.pos, w.rk, w.cls, w.pos - row_number() OVER (PARTITION BY w.doc_id, t.idx, w.rk, w.cls ORDER BY w.pos) AS island FROM word w JOIN {d.t('ctok')} t ON t.doc_id = w.doc_id AND t.pos = w.pos)
    SELECT doc_id, idx, rk, cls, min(pos) AS start_pos, max(pos) + 1 AS end_pos, count(*) AS words FROM g GROUP BY doc_id, idx, rk, cls, island"""


@q("f4_islands", "ctok")
def _(d):
    return f"""WITH g AS (SELECT doc_id, idx, pos, pos - row_number() OVER (PARTITION BY doc_id, idx ORDER BY pos) AS island FROM {d.t('ctok')} WHERE quoted)
    SELECT doc_id, idx, min(pos) AS start_pos, max(pos) + 1 AS end_pos FROM g GROUP BY doc_id, idx, island"""


@q("f15_exclusive_claim", *MATCH)
def _(d):
    return hits(d) + " SELECT doc_id, rk, count(*) AS words FROM (SELECT doc_id, pos, min(rk) AS rk FROM ranked WHERE NOT citation GROUP BY doc_id, pos) z GROUP BY doc_id, rk"


@q("g7_union_coverage", *MATCH)
def _(d):
    return hits(d) + " SELECT doc_id, count(*) AS covered FROM (SELECT DISTINCT doc_id, pos FROM raw) z GROUP BY doc_id"


@q("g8_uncovered_words", *MATCH)
def _(d):
    return hits(d) + f" SELECT t.doc_id, count(*) AS own_words FROM {d.t('ctok')} t LEFT JOIN (SELECT DISTINCT doc_id, pos FROM cover) c ON c.doc_id = t.doc_id AND c.pos = t.pos WHERE c.pos IS NULL GROUP BY t.doc_id"


@q("e4_interval_union", *MATCH)
def _(d):
    return hits(d) + f""", s AS (SELECT doc_id, ref, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, ref ORDER BY pos) + 6 THEN 0 ELSE 1 END AS starts FROM (SELECT DISTINCT doc_id, ref, pos FROM hit WHERE n_hits >= 2) y),
    g AS (SELECT doc_id, ref, pos, sum(starts) OVER (PARTITION BY doc_id, ref ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece FROM s)
    SELECT doc_id, ref, piece, min(pos) AS start_pos, max(pos) + 6 AS end_pos FROM g GROUP BY doc_id, ref, piece"""


@q("b14_canonical_words", "ctok")
def _(d):
    return f"SELECT doc_id, word, count(*) AS n FROM {d.t('ctok')} GROUP BY doc_id, word"


@q("k1_quoted_words", "ctok")
def _(d):
    return f"SELECT doc_id, sum(CASE WHEN quoted THEN 1 ELSE 0 END) AS quoted, sum(CASE WHEN cited THEN 1 ELSE 0 END) AS cited FROM {d.t('ctok')} GROUP BY doc_id"


@q("c10_exclusions", "blk", "cptok")
def _(d):
    return f"""SELECT b.doc_id, b.reason, sum(CASE WHEN b.reason = 'formulas' THEN greatest(1, coalesce(t.n, 0)) ELSE coalesce(t.n, 0) END) AS words FROM {d.t('blk')} b LEFT JOIN (SELECT doc_id, idx, count(*) AS n FROM {d.t('cptok')} GROUP BY doc_id, idx) t ON t.doc_id = b.doc_id AND t.idx = b.idx
    WHERE b.reason IS NOT NULL GROUP BY b.doc_id, b.reason"""


@q("h1_shingles", "sh")
def _(d):
    return f"SELECT doc_id, count(*) AS n, count(DISTINCT h) AS n_distinct, min(h) AS least, max(h) AS most FROM {d.t('sh')} GROUP BY doc_id"


@q("h2_paragraph_shingles", "psh")
def _(d):
    return f"SELECT doc_id, idx, count(*) AS n, min(h) AS least FROM {d.t('psh')} GROUP BY doc_id, idx"


@q("h3_winnow", "fp")
def _(d):
    return f"SELECT doc_id, pos, h FROM {d.t('fp')}"


@q("h10_content_hash", "ctok")
def _(d):
    return f"SELECT doc_id, {d.sha(d.agg_text('word', ' ', 'pos'))} AS content_hash, count(*) AS words FROM {d.t('ctok')} GROUP BY doc_id"


@q("h11_page_hashes", "sh")
def _(d):
    return f"SELECT DISTINCT doc_id, h FROM {d.t('sh')}"


@q("e2_distinct_fingerprints", "fp")
def _(d):
    return f"SELECT doc_id, count(DISTINCT h) AS n FROM {d.t('fp')} GROUP BY doc_id"


def overlap(d: Dialect) -> str:
    """CTEs: classes of documents of one owner with equal fingerprints, and the overlap of their representatives.

    Two documents that share half of the larger set share one of the rarer half of their own hashes, so only those are joined:
    hashes that very many documents hold are left out of the search, but counted in the overlap.
    """
    return f"""WITH f0 AS (SELECT DISTINCT x.doc_id, s.source AS owner, x.h FROM {d.t('fp')} x JOIN {d.t('documents')} s ON s.doc_id = x.doc_id),
    cls AS (SELECT doc_id, owner, n, min(doc_id) OVER (PARTITION BY owner, n, mark) AS rep FROM (SELECT doc_id, owner, count(*) AS n, md5({d.agg_text('CAST(h AS VARCHAR(20))', ',', 'h')}) AS mark FROM f0 GROUP BY doc_id, owner) z),
    f AS (SELECT f0.doc_id, f0.owner, f0.h, c.n, count(*) OVER (PARTITION BY f0.owner, f0.h) AS df FROM f0 JOIN cls c ON c.doc_id = f0.doc_id AND c.rep = f0.doc_id),
    rare AS (SELECT doc_id, owner, h, n FROM (SELECT doc_id, owner, h, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, h) AS k FROM f) z WHERE k <= n - ceil(n / CAST(2 AS DOUBLE)) + 1),
    cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.owner = b.owner AND a.h = b.h AND a.doc_id < b.doc_id AND 2 * a.n >= b.n AND 2 * b.n >= a.n),
    shared AS (SELECT c.a, c.b, CAST(count(*) AS DOUBLE) / greatest(1, greatest(x.n, y.n)) AS v FROM cand c JOIN f x ON x.doc_id = c.a JOIN f y ON y.doc_id = c.b AND y.h = x.h GROUP BY c.a, c.b, x.n, y.n)"""


@q("e3_containment_overlap", "fp")
def _(d):
    return overlap(d) + " SELECT a, b, round(v, 3) AS overlap FROM shared WHERE v >= 0.5"


@q("d18_copies", "fp")
def _(d):
    """One row a document that has a copy: its file class, fingerprint class and the least representative of nine tenths of overlap."""
    return (
        overlap(d)
        + f""", near AS (SELECT rep, min(other) AS other, count(*) AS n FROM (SELECT a AS rep, b AS other FROM shared WHERE v >= 0.9 UNION ALL SELECT b, a FROM shared WHERE v >= 0.9) z GROUP BY rep),
    files AS (SELECT doc_id, min(doc_id) OVER w AS file_rep, count(*) OVER w AS n_file FROM {d.t('documents')} WINDOW w AS (PARTITION BY source, {d.sha('text')})),
    sizes AS (SELECT doc_id, rep, count(*) OVER (PARTITION BY rep) AS n_class FROM cls)
    SELECT f.doc_id, f.file_rep, f.n_file, s.rep, s.n_class, near.other AS near_rep, coalesce(near.n, 0) AS n_near_reps, concat_ws(',', CASE WHEN f.n_file > 1 THEN 'same_file' END, CASE WHEN s.n_class > 1 OR near.n > 0 THEN 'same_text' END) AS reasons
    FROM files f LEFT JOIN sizes s ON s.doc_id = f.doc_id LEFT JOIN near ON near.rep = s.rep WHERE f.n_file > 1 OR s.n_class > 1 OR near.n > 0"""
    )


@q("d3_own_documents", "sh", "pfp")
def _(d):
    """Representatives of equal shingle lists of one owner, compared with each other's stored fingerprints; no cut-off."""
    return f"""WITH m AS (SELECT doc_id, count(*) AS n, md5({d.agg_text('CAST(h AS VARCHAR(20))', ',', 'pos')}) AS mark FROM {d.t('sh')} GROUP BY doc_id),
    r AS (SELECT doc_id, owner FROM (SELECT m.doc_id, s.source AS owner, row_number() OVER (PARTITION BY s.source, m.n, m.mark ORDER BY m.doc_id) AS k FROM m JOIN {d.t('documents')} s ON s.doc_id = m.doc_id) z WHERE k = 1),
    f AS (SELECT DISTINCT x.doc_id, r.owner, x.h FROM {d.t('pfp')} x JOIN r ON r.doc_id = x.doc_id),
    p AS (SELECT a.doc_id, f.doc_id AS other, a.pos FROM {d.t('sh')} a JOIN r ON r.doc_id = a.doc_id JOIN f ON f.h = a.h AND f.owner = r.owner AND f.doc_id <> a.doc_id)
    SELECT doc_id, other, count(*) AS n_hits FROM p GROUP BY doc_id, other HAVING count(*) >= 2"""


@q("h6_internal_duplicates", "psh")
def _(d):
    return f"""WITH s AS (SELECT doc_id, idx, pos, h, count(*) OVER (PARTITION BY doc_id, idx) AS n FROM {d.t('psh')}),
    c AS (SELECT doc_id, idx, h, n FROM (SELECT doc_id, idx, h, n, row_number() OVER (PARTITION BY doc_id, h ORDER BY idx) AS k FROM (SELECT DISTINCT doc_id, idx, h, n FROM s) y) z WHERE k <= 24),
    p AS (SELECT a.doc_id, least(a.idx, b.idx) AS i, greatest(a.idx, b.idx) AS j, count(*) AS hits, min(least(a.n, b.n)) AS n FROM s a JOIN c b ON a.doc_id = b.doc_id AND a.h = b.h AND a.idx <> b.idx GROUP BY a.doc_id, least(a.idx, b.idx), greatest(a.idx, b.idx))
    SELECT doc_id, i, j, hits, round(least(CAST(1 AS DOUBLE), CAST(hits AS DOUBLE) / n / 2), 3) AS similarity FROM p WHERE hits >= 6 AND CAST(hits AS DOUBLE) / n / 2 >= 0.15"""


@q("h7_cross_document", "psh", "pfp", "cptok")
def _(d):
    """Of every hash the first three postings in other documents count; those lie in the first four documents, three in each."""
    return f"""WITH post AS (SELECT h, doc_id, idx, docs FROM (SELECT h, doc_id, idx, dense_rank() OVER (PARTITION BY h ORDER BY doc_id) AS dk, row_number() OVER (PARTITION BY h, doc_id ORDER BY idx) AS k, min(doc_id) OVER (PARTITION BY h) <> max(doc_id) OVER (PARTITION BY h) AS docs FROM {d.t('pfp')}) z WHERE dk <= 4 AND k <= 3),
    p AS (SELECT a.doc_id, a.idx, a.pos, b.doc_id AS other, b.idx AS other_idx, row_number() OVER (PARTITION BY a.doc_id, a.idx, a.pos ORDER BY b.doc_id, b.idx) AS k FROM {d.t('psh')} a JOIN post b ON a.h = b.h AND a.doc_id <> b.doc_id),
    c AS (SELECT doc_id, idx, other, other_idx, count(*) AS hits FROM p WHERE k <= 3 GROUP BY doc_id, idx, other, other_idx),
    best AS (SELECT doc_id, idx, other, other_idx, hits FROM (SELECT doc_id, idx, other, other_idx, hits, row_number() OVER (PARTITION BY doc_id, idx, other ORDER BY hits DESC, other_idx) AS k FROM c) z WHERE k = 1 AND hits >= 3),
    cov AS (SELECT doc_id, idx, count(*) AS covered FROM (SELECT DISTINCT doc_id, idx, pos + o AS pos FROM (SELECT doc_id, idx, pos, {d.explode(d.series('0', '5'))} AS o FROM (SELECT DISTINCT doc_id, idx, pos FROM p) x) y) z GROUP BY doc_id, idx),
    t AS (SELECT doc_id, idx, count(*) AS n FROM {d.t('cptok')} GROUP BY doc_id, idx)
    SELECT b.doc_id, b.idx, b.other, b.other_idx, b.hits, round(least(CAST(1 AS DOUBLE), CAST(c.covered AS DOUBLE) / greatest(1, t.n)), 3) AS similarity FROM best b JOIN cov c ON c.doc_id = b.doc_id AND c.idx = b.idx JOIN t ON t.doc_id = b.doc_id AND t.idx = b.idx"""


@q("h5_stored_fingerprints", "pfp")
def _(d):
    return f"SELECT doc_id, idx, h FROM {d.t('pfp')}"


@q("f1_shingle_words", "cptok")
def _(d):
    leads = ", ".join(f"lead(word, {i}) OVER (PARTITION BY doc_id, idx ORDER BY pos) AS w{i}" for i in range(1, 6))
    return f"SELECT doc_id, idx, pos, md5(concat_ws(' ', word, w1, w2, w3, w4, w5)) AS gram FROM (SELECT doc_id, idx, pos, word, {leads} FROM {d.t('cptok')}) z WHERE w5 IS NOT NULL"


@q("h8_repeated_phrases", "cptok")
def _(d):
    """Phrases of five to nine words, three of them content words, that stand in three passages of a document."""
    leads = ", ".join(f"lead(word, {i}) OVER w AS w{i}, lead(content, {i}) OVER w AS c{i}" for i in range(1, 9))
    among = ", ".join(d.lit(w) for w in canonical_stop())
    gram = lambda n: f"concat_ws(' ', {', '.join(['word', *(f'w{i}' for i in range(1, n))])})"
    content = lambda n: " + ".join(["content", *(f"c{i}" for i in range(1, n))])
    grams = " UNION ALL ".join(f"SELECT doc_id, idx, {n} AS n, {gram(n)} AS phrase FROM g WHERE {content(n)} >= 3" for n in range(5, 10))
    return f"""WITH t AS (SELECT doc_id, idx, pos, word, CASE WHEN word IN ({among}) THEN 0 ELSE 1 END AS content FROM {d.t('cptok')}), g AS (SELECT doc_id, idx, word, content, {leads} FROM t WINDOW w AS (PARTITION BY doc_id, idx ORDER BY pos))
    SELECT doc_id, n, phrase, count(DISTINCT idx) AS passages FROM ({grams}) z GROUP BY doc_id, n, phrase HAVING count(DISTINCT idx) >= 3"""


@q("j2_ingest_gate", "ctok")
def _(d):
    return f"""WITH c AS (SELECT doc_id, {d.sha(d.agg_text('word', ' ', 'pos'))} AS content_hash, count(*) AS words FROM {d.t('ctok')} GROUP BY doc_id),
    k AS (SELECT doc_id, words, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS k FROM c)
    SELECT doc_id, words, CASE WHEN words < 60 THEN 'too_short' WHEN k > 1 THEN 'duplicate' ELSE 'added' END AS status FROM k"""


@q("j3_delete_reference", "rfp")
def _(d):
    return f"SELECT f.doc_id, count(*) AS n FROM {d.t('rfp')} f LEFT JOIN (SELECT item_id FROM {d.t('benchmark')} WHERE item_id < 5) x ON x.item_id = f.doc_id WHERE x.item_id IS NULL GROUP BY f.doc_id"


@q("e1_corpus_stats")
def _(d):
    return f"SELECT source, lang, count(*) AS documents, coalesce(sum(n_chars), 0) AS chars, count(DISTINCT text) AS texts FROM {d.t('documents')} GROUP BY source, lang"


@q("k11_query_planning", "tok")
def _(d):
    return f"SELECT doc_id, words, least(40, greatest(2, CAST(ceil(words / CAST(1000 AS DOUBLE)) AS INT))) AS module_queries, least(150, greatest(3, CAST(ceil(words / CAST(400 AS DOUBLE)) AS INT))) AS web_queries FROM (SELECT doc_id, count(*) AS words FROM {d.t('tok')} GROUP BY doc_id) z"


@q("k12_distinctive_sentences", "sent", "tok")
def _(d):
    return f"""WITH f AS (SELECT word, count(*) AS n FROM {d.t('tok')} GROUP BY word), t AS (SELECT count(*) AS n FROM {d.t('tok')}),
    w AS (SELECT doc_id, idx, n, {d.explode(d.rall('lower(sentence)', "[a-zß-öø-ÿ]+"))} AS word FROM {d.t('sent')}),
    r AS (SELECT w.doc_id, w.idx, w.n, count(*) AS words, avg(ln(CAST(t.n AS DOUBLE) / f.n)) AS rarity FROM w JOIN f ON f.word = w.word CROSS JOIN t GROUP BY w.doc_id, w.idx, w.n),
    k AS (SELECT doc_id, idx, n, words, rarity, row_number() OVER (PARTITION BY doc_id ORDER BY round(rarity, 9) DESC, idx, n) AS k FROM r WHERE words BETWEEN 10 AND 45)
    SELECT doc_id, idx, n, words, round(rarity, 6) AS rarity FROM k WHERE k <= 3"""


@q("f13_chunk_windows", "tok")
def _(d):
    last = d.idiv("greatest(n - 50, 0) + 24", "25")
    return f"SELECT doc_id, o * 25 AS start_pos, least(n, o * 25 + 50) AS end_pos FROM (SELECT doc_id, n, {d.explode(d.series('0', f'CAST({last} AS INT)'))} AS o FROM (SELECT doc_id, count(*) AS n FROM {d.t('tok')} GROUP BY doc_id) z WHERE n >= 20) y"


@q("contaminated_items", *MATCH)
def _(d):
    return hits(d) + f" SELECT b.item_id, count(DISTINCT s.doc_id) AS n_docs FROM {d.t('benchmark')} b LEFT JOIN kept s ON s.ref = b.item_id GROUP BY b.item_id"




@q("k6_template_words", "ctok")
def _(d):
    return f"""WITH f AS ({template_words(d)}), m AS (SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT doc_id, pos, {d.explode(d.series('0', 'n - 1'))} AS o FROM f) z)
    SELECT x.doc_id, x.occurrences, y.words FROM (SELECT doc_id, count(*) AS occurrences FROM f GROUP BY doc_id) x JOIN (SELECT doc_id, count(*) AS words FROM m GROUP BY doc_id) y ON y.doc_id = x.doc_id"""


PAYLOADS = [
    (1, '{"title": "On Spark", "publication_year": 2020, "doi": "https://doi.org/10.1/AB", "abstract": "<jats:p>Short text</jats:p>"}'),
    (2, '{"title": "Zweite Arbeit", "publication_year": 1999, "doi": "10.2/x", "abstract": "plain"}'),
    (3, '{"title": "No year"}'),
]


@q("a31_payload_records")
def _(d):
    rows = ", ".join(f"({i}, {d.lit(b)})" for i, b in PAYLOADS)
    return f"""WITH p AS (SELECT * FROM (VALUES {rows}) AS p_seed(id, body))
    SELECT id, {d.json('body', 'title')} AS title, CAST({d.json('body', 'publication_year')} AS INT) AS year, lower({d.rr(d.json('body', 'doi'), '^https?://doi.org/', '')}) AS doi, trim({d.rr(d.json('body', 'abstract'), '<[^>]+>', ' ')}) AS abstract FROM p"""
