"""Structure of documents (contents, headings, sections, references) and what is counted by section.

Documents of the tables have few headings, so a made-up thesis (document -1) stands beside them in every query here.
"""

from __future__ import annotations

from folioscope.functions import profiles
from folioscope.operators.canonical import CYRILLIC, canonical, display
from folioscope.plans.dialect import Dialect
from folioscope.plans.queries_corpus import canonical_stop

SHARED: dict = {}

THESIS = [
    "A Study of Village Schools", "Table of contents", "Introduction .......... 3", "Chapter 1 The schools ...... 5", "1.1. Village history 6", "References ...... 40", "This line ends the contents because it has no page.",
    "Introduction", "Schools of the valley were studied by many authors [1, 3-5]. The pupils read (Smith, 2001) and wrote.", "CHAPTER 1. THE SCHOOLS", "1.1. History of the schools",
    "The first school was opened in 1905. 2.5 million pupils followed it, as was found out [7].", "1.1.1. The first years", "Old papers tell little of them.", "1.3. Teachers of the valley", "Teachers came from the town.",
    "2.1 Present day", "«a long quotation that nobody would take for own words» [2] stands here.", "2.5 million pupils were counted.", "§ 2.2 The roads", "Conclusion.", "All was said.", "References",
    "1. Smith J. A study of things. Oxford, 2001.", "2. Karimov A. Ilmiy maqola. Toshkent, 2019.", "[3] Doe A. No year given.", "4) Brown B. Old work. London, 1987.", "1. Smith J. A study of things. Oxford, 2001.", "Ivanov I. Unnumbered work, 1999.",
]


def q(name: str, *bases: str):
    def add(build):
        SHARED[name] = (bases, build)
        return build

    return add


def lines(d: Dialect) -> str:
    """doc_id, idx, text (as shown), nw of all lines."""
    seed = ", ".join(f"(CAST(-1 AS BIGINT), {i}, {d.lit(t)})" for i, t in enumerate(THESIS))
    both = f"SELECT doc_id, idx, {display(d, 'text')} AS text FROM {d.t('para')} UNION ALL SELECT doc_id, idx, {display(d, 'text')} AS text FROM (VALUES {seed}) AS thesis(doc_id, idx, text)"
    return f"SELECT doc_id, idx, text, {d.rcount('text', profiles.WORD)} AS nw FROM ({both}) l0"


def keyword_kind(d: Dialect, t: str) -> str:
    cases = []
    for words in profiles.SECTION_WORDS.values():
        for kind, forms in words.items():
            any_ = "|".join(sorted(forms, key=lambda w: (-len(w), w)))
            cases.append(f"WHEN {d.rlike(t, f'^(?:{any_})' + ('' if kind == 'keywords' else '.{0,45}$'))} THEN '{kind}'")
    return f"CASE {' '.join(cases)} END"


def headings(d: Dialect) -> str:
    """CTEs. marked: lines with the kind by their words, whether they are entries of contents, and lie in contents; head: headings."""
    bare = d.rr(d.rr("lower(text)", "^\\s*(?:[ivxlc]+|[0-9]+(?:[.][0-9]+)*)[.)]?\\s+", ""), "^[ :.–—-]+|[ :.–—-]+$", "")
    short = "(length(text) <= 200 AND nw <= 25)"
    entry = f"({d.rlike('text', '([.]{3,}|…{2,}|_{3,}|\\t)\\s*[0-9]{1,4}\\s*$')} OR ({d.rlike('text', '\\s[0-9]{1,4}$')} AND nw >= 2))"
    kind = f"CASE WHEN {short} OR {d.rlike('lower(text)', '^(kalit|keyword|ключев|tayanch)')} THEN {keyword_kind(d, d.rr('bare', '\\s+', ' '))} END"
    over = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    chapter = d.rlike("lower(text)", "^\\s*(?:" + "|".join(f"(?:{p})" for ps in profiles.CHAPTERS.values() for p in ps) + ")")
    plausible = f"((NOT {d.rlike('text', '[.]\\s*$')} AND nw <= 25) OR nw <= 12)"
    m3, m2 = "^\\s*([0-9]+[.][0-9]+[.][0-9]+)[.]?\\s+\\p{Lu}", "^\\s*([0-9]+[.][0-9]+)[.]?\\s+\\p{Lu}"
    level = f"""CASE WHEN kind = 'toc' THEN 1 WHEN in_toc OR ({short} AND entry) THEN NULL WHEN {short} AND {chapter} THEN 1 WHEN {short} AND {d.rlike('text', m3)} AND {plausible} THEN 3 WHEN {short} AND {d.rlike('text', m2)} AND {plausible} THEN 2
        WHEN {short} AND {d.rlike('lower(text)', '^\\s*([0-9]+)\\s*[-–]\\s*(?:§|paragraf|параграф)|^\\s*§\\s*[0-9]+[.][0-9]+')} THEN 2 WHEN kind IS NOT NULL THEN 1 END"""
    named = f"""CASE WHEN kind = 'toc' THEN 'toc' WHEN {short} AND {chapter} THEN 'chapter' WHEN {short} AND {d.rlike('text', m3)} AND {plausible} THEN 'subsection' WHEN level = 2 THEN 'section' ELSE kind END"""
    number = f"CASE WHEN level = 3 THEN {d.rx('text', m3, 1)} WHEN level = 2 AND {d.rlike('text', m2)} THEN {d.rx('text', m2, 1)} END"
    return f"""WITH marked AS (SELECT doc_id, idx, text, nw, kind, entry, entry AND coalesce(max(CASE WHEN kind = 'toc' THEN idx END) {over}, -1) > coalesce(max(CASE WHEN NOT entry AND coalesce(kind, '') <> 'toc' THEN idx END) {over}, -1) AS in_toc
        FROM (SELECT doc_id, idx, text, nw, {kind} AS kind, {entry} AS entry FROM (SELECT doc_id, idx, text, nw, {bare} AS bare FROM ({lines(d)}) k0 WHERE nw > 0) k1) k2),
    head AS (SELECT doc_id, idx, text, level, {named} AS kind, {number} AS number FROM (SELECT doc_id, idx, text, nw, kind, {level} AS level FROM marked) h0 WHERE level IS NOT NULL)"""


def tree(d: Dialect) -> str:
    """CTEs as headings(), and sec: parent, end (next heading that is no deeper) and own_end (next heading) of every heading; body: lines with their section."""
    ahead = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    behind = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    nearest = lambda test, window, pick: f"{pick}(CASE WHEN level {test} THEN idx END) {window}"
    return (
        headings(d)
        + f""", sec AS (SELECT doc_id, idx, text, level, kind, number, CASE level WHEN 2 THEN {nearest('< 2', behind, 'max')} WHEN 3 THEN {nearest('< 3', behind, 'max')} END AS parent,
        CASE level WHEN 1 THEN {nearest('<= 1', ahead, 'min')} WHEN 2 THEN {nearest('<= 2', ahead, 'min')} ELSE min(idx) {ahead} END AS section_end, min(idx) {ahead} AS own_end FROM head),
    body AS (SELECT m.doc_id, m.idx, m.text, m.nw, h.idx AS heading, max(h.idx) OVER (PARTITION BY m.doc_id ORDER BY m.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM marked m LEFT JOIN head h ON h.doc_id = m.doc_id AND h.idx = m.idx)"""
    )


@q("m3_heading_kinds", "para")
def _(d):
    return headings(d) + " SELECT doc_id, idx, kind FROM marked WHERE kind IS NOT NULL"


@q("m4_toc_entries", "para")
def _(d):
    return headings(d) + " SELECT doc_id, idx, in_toc FROM marked WHERE entry"


@q("f17_toc_region", "para")
def _(d):
    return headings(d) + " SELECT doc_id, min(idx) AS first_entry, max(idx) AS last_entry, count(*) AS n FROM marked WHERE in_toc GROUP BY doc_id"


@q("m5_numbered_lines", "para")
def _(d):
    return headings(d) + f" SELECT m.doc_id, m.idx, h.idx IS NOT NULL AS is_heading FROM marked m LEFT JOIN head h ON h.doc_id = m.doc_id AND h.idx = m.idx WHERE {d.rlike('m.text', '^\\s*[0-9]+[.][0-9]+')}"


@q("m6_headings", "para")
def _(d):
    return headings(d) + " SELECT doc_id, idx, level, kind, number FROM head"


@q("f9_section_ends", "para")
def _(d):
    return tree(d) + " SELECT doc_id, idx, level, own_end, section_end FROM sec"


@q("m8_section_tree", "para")
def _(d):
    return tree(d) + " SELECT doc_id, idx, level, kind, parent FROM sec"


@q("d7_leaf_sections", "para")
def _(d):
    return tree(d) + " SELECT s.doc_id, s.idx FROM sec s LEFT JOIN sec c ON c.doc_id = s.doc_id AND c.parent = s.idx WHERE c.idx IS NULL"


@q("f10_chapters", "para")
def _(d):
    return tree(d) + " SELECT s.doc_id, s.idx, coalesce(g.idx, p.idx, s.idx) AS chapter FROM sec s LEFT JOIN sec p ON p.doc_id = s.doc_id AND p.idx = s.parent LEFT JOIN sec g ON g.doc_id = p.doc_id AND g.idx = p.parent"


@q("d9_block_sections", "para")
def _(d):
    return tree(d) + " SELECT doc_id, idx, coalesce(section, -1) AS section FROM body"


@q("d8_section_words", "para")
def _(d):
    """Words of each section with all that lies below it: lines joined to the sections whose range holds them."""
    return tree(d) + " SELECT s.doc_id, s.idx, count(b.idx) AS n_lines, sum(b.nw) AS words FROM sec s JOIN body b ON b.doc_id = s.doc_id AND b.heading IS NULL AND b.idx >= s.idx AND (s.section_end IS NULL OR b.idx < s.section_end) GROUP BY s.doc_id, s.idx"


@q("e30_components", "para")
def _(d):
    return tree(d) + " SELECT s.doc_id, s.kind, count(DISTINCT s.idx) AS sections, coalesce(sum(b.nw), 0) AS words FROM sec s LEFT JOIN body b ON b.doc_id = s.doc_id AND b.section = s.idx AND b.heading IS NULL GROUP BY s.doc_id, s.kind"


@q("c9_excluded_by_kind", "para")
def _(d):
    return tree(d) + " SELECT b.doc_id, s.kind, sum(b.nw) AS words FROM body b JOIN sec s ON s.doc_id = b.doc_id AND s.idx = b.section WHERE s.kind IN ('references', 'toc', 'title', 'appendix', 'keywords') GROUP BY b.doc_id, s.kind"


NUMERIC = profiles.NUMERIC_CITATION
AUTHOR_YEAR = "[(][^()]{0,80}?(?:19|20)[0-9]{2}[a-z]?[^()]{0,20}[)]"


@q("m14_sections_without_citations", "para")
def _(d):
    cites = f"{d.rcount('b.text', NUMERIC)} + {d.rcount('b.text', AUTHOR_YEAR)}"
    return tree(d) + f" SELECT s.doc_id, s.idx, sum(b.nw) AS words FROM sec s JOIN body b ON b.doc_id = s.doc_id AND b.section = s.idx AND b.heading IS NULL WHERE s.kind IN ('literature_review', 'chapter', 'section', 'introduction') GROUP BY s.doc_id, s.idx HAVING sum(b.nw) >= 250 AND sum({cites}) = 0"


@q("m16_numbering_gaps", "para")
def _(d):
    a, b = "CAST(" + d.rx("number", "^([0-9]+)", 1) + " AS INT)", "CAST(" + d.rx("number", "^[0-9]+[.]([0-9]+)", 1) + " AS INT)"
    return tree(d) + f""", n AS (SELECT doc_id, idx, {a} AS a, {b} AS b FROM sec WHERE number IS NOT NULL), p AS (SELECT doc_id, idx, a, b, lag(a) OVER w AS a1, lag(b) OVER w AS b1 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, idx, a, b FROM p WHERE (a = a1 AND b > b1 + 1) OR (a = a1 + 1 AND b <> 1)"""


@q("f6_neighbour_headings", "para")
def _(d):
    return tree(d) + " SELECT doc_id, idx, lag(number) OVER (PARTITION BY doc_id ORDER BY idx) AS before_number, number FROM sec WHERE number IS NOT NULL"


@q("m16_heading_case", "para")
def _(d):
    return tree(d) + f" SELECT doc_id, count(*) AS n, sum(CASE WHEN text = upper(text) THEN 1 ELSE 0 END) AS upper_n, sum(CASE WHEN {d.rlike('text', '[.]\\s*$')} THEN 1 ELSE 0 END) AS period_n, sum(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) AS chapters FROM sec WHERE kind <> 'keywords' GROUP BY doc_id"


def references(d: Dialect) -> str:
    """CTEs as tree(), and ref: the lines of reference lists with their number; cited: numbers cited in the text, ranges of less than 50 spelt out."""
    number = d.rx("b.text", "^\\s*\\[?([0-9]{1,3})[\\]).]", 1)
    part = d.rx("part", "^\\s*([0-9]+)", 1), d.rx("part", "^\\s*[0-9]+\\s*[–-]\\s*([0-9]+)", 1)
    return (
        tree(d)
        + f""", ref AS (SELECT doc_id, idx, text, place, CASE WHEN number = '' THEN place ELSE CAST(number AS INT) END AS number FROM (SELECT b.doc_id, b.idx, b.text, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY b.idx) AS INT) AS place, {number} AS number
        FROM body b JOIN sec s ON s.doc_id = b.doc_id AND s.idx = b.section WHERE s.kind = 'references' AND b.heading IS NULL) r0),
    spec AS (SELECT doc_id, {d.explode(d.split("replace(replace(replace(mark, '[', ''), ']', ''), ';', ',')", ","))} AS part FROM (SELECT b.doc_id, {d.explode(d.rall('b.text', NUMERIC))} AS mark FROM body b LEFT JOIN sec s ON s.doc_id = b.doc_id AND s.idx = b.section WHERE coalesce(s.kind, '') <> 'references') s0),
    span AS (SELECT doc_id, CAST(a AS INT) AS a, CASE WHEN z = '' THEN CAST(a AS INT) ELSE CAST(z AS INT) END AS z, z <> '' AS ranged FROM (SELECT doc_id, substr({part[0]}, 1, 6) AS a, substr({part[1]}, 1, 6) AS z FROM spec) s1 WHERE a <> ''),
    cited AS (SELECT doc_id, {d.explode(d.series('a', 'z'))} AS number FROM span WHERE NOT ranged OR (z > a AND z - a < 50))"""
    )


@q("b31_cited_numbers", "para")
def _(d):
    return references(d) + " SELECT doc_id, number, count(*) AS n FROM cited GROUP BY doc_id, number"


@q("d21_citations_and_references", "para")
def _(d):
    return (
        references(d)
        + """, last AS (SELECT doc_id, max(number) AS most FROM ref GROUP BY doc_id)
    SELECT c.doc_id, c.number, 'missing' AS status FROM (SELECT DISTINCT doc_id, number FROM cited) c JOIN last l ON l.doc_id = c.doc_id WHERE c.number > l.most
    UNION ALL SELECT r.doc_id, r.number, 'uncited' FROM (SELECT DISTINCT doc_id, number FROM ref) r LEFT JOIN (SELECT DISTINCT doc_id, number FROM cited) c ON c.doc_id = r.doc_id AND c.number = r.number WHERE c.number IS NULL"""
    )


@q("m15_references", "para")
def _(d):
    year, bare = d.rx("text", "(18|19|20)[0-9][0-9]"), d.rr("lower(text)", "^\\s*\\[?[0-9]+[\\]).]\\s*", "")
    return references(d) + f" SELECT doc_id, idx, number, {year} AS year, {year} = '' AS missing_year, count(*) OVER (PARTITION BY doc_id, {bare}) > 1 AS duplicate, number <> place AS odd_number FROM ref"


@q("e20_reference_years", "para")
def _(d):
    year = f"CAST(nullif({d.rx('text', '(18|19|20)[0-9][0-9]')}, '') AS INT)"
    return references(d) + f" SELECT doc_id, min(y) AS least, max(y) AS most, sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS missing, round(avg(CASE WHEN y < 2016 THEN CAST(1 AS DOUBLE) WHEN y IS NOT NULL THEN 0 END), 4) AS old_share, count(*) AS n FROM (SELECT doc_id, {year} AS y FROM ref) z GROUP BY doc_id"


@q("m13_citation_style", "para")
def _(d):
    return references(d) + f""", a AS (SELECT doc_id, count(*) AS n FROM cited GROUP BY doc_id), b AS (SELECT doc_id, sum({d.rcount('text', AUTHOR_YEAR)}) AS n FROM body GROUP BY doc_id)
    SELECT b.doc_id, CASE WHEN a.n > 0 AND b.n > 0 THEN 'mixed' WHEN a.n > 0 THEN 'numeric' WHEN b.n > 0 THEN 'author_year' ELSE 'none' END AS style, coalesce(a.n, 0) AS numeric_n, b.n AS author_year_n FROM b LEFT JOIN a ON a.doc_id = b.doc_id"""


@q("c14_candidate_sentences", "sent")
def _(d):
    return f"SELECT doc_id, idx, n FROM {d.t('sent')} WHERE {d.rcount('sentence', profiles.WORD)} BETWEEN 10 AND 45 AND NOT {d.rlike('sentence', NUMERIC)} AND NOT {d.rlike('sentence', AUTHOR_YEAR)} AND NOT {d.rlike('sentence', '[«»“”„]')}"


@q("b19_query_texts", "sent")
def _(d):
    """The middle 18 words of a sentence, at most 350 characters, cut at a space."""
    middle = d.join(d.slice("w", "(1 + greatest(0, " + d.idiv("n_words - 18", "2") + "))", "18"), " ")
    return f"SELECT doc_id, idx, n, CASE WHEN length(m) <= 350 THEN m ELSE {d.rr('substr(m, 1, 350)', ' [^ ]*$', '')} END AS query FROM (SELECT doc_id, idx, n, {middle} AS m FROM (SELECT doc_id, idx, n, w, {d.size('w')} AS n_words FROM (SELECT doc_id, idx, n, {d.rall('sentence', '[^ ]+')} AS w FROM {d.t('sent')}) a) b) c"


@q("b20_keywords", "tok")
def _(d):
    """Content words of more than three letters, each once, in order, while they fit in 200 characters."""
    among = ", ".join(d.lit(w) for w in sorted({w for ws in profiles.STOP.values() for w in ws}))
    return f"""SELECT doc_id, {d.agg_text('word', ' ', 'pos')} AS keywords FROM (SELECT doc_id, word, pos, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM (
    SELECT doc_id, word, min(pos) AS pos FROM {d.t('tok')} WHERE length(word) > 3 AND word NOT IN ({among}) GROUP BY doc_id, word) a) b WHERE used <= 201 GROUP BY doc_id"""


@q("g6_distinct_in_order", "tok")
def _(d):
    return f"SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM (SELECT doc_id, word, min(pos) AS pos FROM {d.t('tok')} GROUP BY doc_id, word) z"


@q("b4_lower_words", "tok")
def _(d):
    return f"SELECT doc_id, word, count(*) AS n FROM {d.t('tok')} GROUP BY doc_id, word"


@q("b29_token_shapes", "tok")
def _(d):
    among = ", ".join(d.lit(w) for w in profiles.STOP_EN)
    return f"SELECT doc_id, CASE WHEN word IN ({among}) THEN word ELSE 'W' END AS shape, count(*) AS n FROM {d.t('tok')} GROUP BY doc_id, CASE WHEN word IN ({among}) THEN word ELSE 'W' END"


@q("b15_stop_words")
def _(d):
    return f"SELECT {d.explode(d.list_(*(d.lit(w) for w in canonical_stop())))} AS word"


SPELLINGS = [(-1, "Kitob Китоб kit​ob Ўқувчи oʻquvchi cтатья ёлка школа maʼno pасчёт щит ночь оp хc аbв")]


def spelt(d: Dialect) -> str:
    """doc_id, token (as shown) of all documents and of the spellings above."""
    seeds = ", ".join(f"(CAST({i} AS BIGINT), {d.lit(t)})" for i, t in SPELLINGS)
    return f"SELECT doc_id, {d.explode(d.rall(display(d, 'text'), profiles.WORD))} AS token FROM (SELECT doc_id, text FROM {d.t('documents')} UNION ALL SELECT doc_id, text FROM (VALUES {seeds}) AS spellings(doc_id, text)) s0"


@q("b9_display_text")
def _(d):
    return f"SELECT doc_id, md5({display(d, 'text')}) AS h, length({display(d, 'text')}) AS n FROM {d.t('documents')}"


@q("b8_invisible_in_documents")
def _(d):
    return f"SELECT doc_id, length(text) - length(translate(text, {d.lit(profiles.INVISIBLE)}, '')) AS n FROM {d.t('documents')}"


@q("b12_canonical_forms")
def _(d):
    return f"SELECT doc_id, token, {canonical(d, 'token')} AS word, count(*) AS n FROM ({spelt(d)}) z GROUP BY doc_id, token, {canonical(d, 'token')}"


@q("b10_repaired_words")
def _(d):
    """Words of two scripts in the script that most of their letters have; of equals, Cyrillic."""
    lat, cyr = d.rcount("token", "[a-zA-Z]"), d.rcount("token", CYRILLIC)
    to_cyr, to_lat = (f"translate(token, {d.lit(a)}, {d.lit(b)})" for a, b in ((profiles.LAT_BACK, profiles.CYR_BACK), (profiles.CYR_LOOK, profiles.LAT_LOOK)))
    return f"SELECT DISTINCT doc_id, token, CASE WHEN {cyr} >= {lat} THEN {to_cyr} ELSE {to_lat} END AS repaired FROM ({spelt(d)}) z WHERE {lat} > 0 AND {cyr} > 0"


@q("b11_transliterated")
def _(d):
    return f"SELECT DISTINCT token, {canonical(d, 'token')} AS latin FROM ({spelt(d)}) z WHERE {d.rlike('token', CYRILLIC)} AND NOT {d.rlike('token', '[a-zA-Z]')}"


@q("e21_homoglyph_words")
def _(d):
    return f"SELECT doc_id, count(*) AS n, count(DISTINCT token) AS forms FROM ({spelt(d)}) z WHERE length(token) >= 3 AND {d.rlike('token', '[a-zA-Z]')} AND {d.rlike('token', CYRILLIC)} GROUP BY doc_id"


@q("f14_pieces", "cptok")
def _(d):
    """Pieces of 50 words of every passage; a tail of fewer than 25 belongs to the piece before."""
    last = f"greatest(0, {d.idiv('n', '50')} - CASE WHEN n % 50 >= 25 THEN 0 ELSE 1 END)"
    return f"SELECT doc_id, idx, piece * 50 AS start_pos, CASE WHEN piece = last THEN n ELSE piece * 50 + 50 END AS end_pos FROM (SELECT doc_id, idx, n, last, {d.explode(d.series('0', 'CAST(last AS INT)'))} AS piece FROM (SELECT doc_id, idx, n, {last} AS last FROM (SELECT doc_id, idx, count(*) AS n FROM {d.t('cptok')} GROUP BY doc_id, idx) a) b) c"


@q("e14_similarity_coverage", "psh", "pfp", "cptok")
def _(d):
    """Share of a document's words in shingles of another of its passages, of another document, and of either."""
    at = d.explode(d.series("0", "5"))
    return f"""WITH own AS (SELECT DISTINCT a.doc_id, a.idx, a.pos FROM {d.t('psh')} a JOIN (SELECT doc_id, h FROM {d.t('psh')} GROUP BY doc_id, h HAVING count(DISTINCT idx) >= 2) b ON b.doc_id = a.doc_id AND b.h = a.h),
    other AS (SELECT DISTINCT a.doc_id, a.idx, a.pos FROM {d.t('psh')} a JOIN (SELECT h, min(doc_id) AS low, max(doc_id) AS high FROM {d.t('pfp')} GROUP BY h) b ON b.h = a.h AND (b.low <> a.doc_id OR b.high <> a.doc_id)),
    w AS (SELECT doc_id, idx, pos, max(i) AS internal, max(c) AS corpus FROM (SELECT doc_id, idx, pos + o AS pos, i, c FROM (SELECT doc_id, idx, pos, {at} AS o, i, c FROM (SELECT doc_id, idx, pos, 1 AS i, 0 AS c FROM own UNION ALL SELECT doc_id, idx, pos, 0, 1 FROM other) x) y) z GROUP BY doc_id, idx, pos),
    s AS (SELECT doc_id, sum(internal) AS internal, sum(corpus) AS corpus, count(*) AS either FROM w GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS n FROM {d.t('cptok')} GROUP BY doc_id)
    SELECT t.doc_id, {', '.join(f"round(CAST(100 AS DOUBLE) * coalesce(s.{c}, 0) / t.n, 2) AS {c}" for c in ('internal', 'corpus', 'either'))} FROM t LEFT JOIN s ON s.doc_id = t.doc_id"""


@q("j1_body_words", "blk", "cptok")
def _(d):
    return f"SELECT b.doc_id, count(DISTINCT b.idx) AS n_lines, count(t.pos) AS words FROM {d.t('blk')} b LEFT JOIN {d.t('cptok')} t ON t.doc_id = b.doc_id AND t.idx = b.idx WHERE b.reason IS NULL GROUP BY b.doc_id"


@q("i1_hash_embedding", "tok")
def _(d):
    """Counts of the 3- to 5-grams of spaced words in 512 buckets, as a unit vector."""
    grams = " UNION ALL ".join(f"SELECT doc_id, c, substr(g, i, {n}) AS gram FROM (SELECT doc_id, c, g, {d.explode(d.numbers('1', f'length(g) - {n - 1}'))} AS i FROM g) g{n}" for n in (3, 4, 5))
    return f"""WITH g AS (SELECT doc_id, concat(' ', word, ' ') AS g, count(*) AS c FROM {d.t('tok')} GROUP BY doc_id, word), b AS (SELECT doc_id, {d.h60('gram')} % 512 AS bucket, sum(c) AS c FROM ({grams}) z GROUP BY doc_id, {d.h60('gram')} % 512)
    SELECT doc_id, bucket, round(c / sqrt(sum(CAST(c AS DOUBLE) * c) OVER (PARTITION BY doc_id)), 6) AS x FROM b"""
