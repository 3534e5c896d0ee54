"""Canonical words and checked token streams: one definition for both engines, as SQL expressions.

A canonical word has straight apostrophes and no invisible characters, is in one script (look-alike letters are
changed to the script that most of its letters have), lower case, and in Latin letters.
"""

from __future__ import annotations

from folioscope.functions import profiles
from folioscope.plans.dialect import Dialect

CYRILLIC = "[Ѐ-ӿ]"


def display(d: Dialect, x: str) -> str:
    """Straight apostrophes, no invisible characters."""
    marks = profiles.APOSTROPHES
    return f"translate(translate({x}, {d.lit(profiles.INVISIBLE)}, ''), {d.lit(marks)}, {d.lit(chr(39) * len(marks))})"


def canonical(d: Dialect, x: str) -> str:
    """The canonical word of a displayed word."""
    lat, cyr = d.rcount(x, "[a-zA-Z]"), d.rcount(x, CYRILLIC)
    to_cyr = f"translate({x}, {d.lit(profiles.LAT_BACK)}, {d.lit(profiles.CYR_BACK)})"
    to_lat = f"translate({x}, {d.lit(profiles.CYR_LOOK)}, {d.lit(profiles.LAT_LOOK)})"
    out = f"lower(CASE WHEN {lat} > 0 AND {cyr} >= {lat} THEN {to_cyr} WHEN {lat} > 0 THEN {to_lat} ELSE {x} END)"
    for a, b in profiles.TRANSLIT_MANY:
        out = f"replace({out}, {d.lit(a)}, {d.lit(b)})"
    out = f"translate({out}, {d.lit(profiles.TRANSLIT_ONE[0])}, {d.lit(profiles.TRANSLIT_ONE[1])})"
    return f"CASE WHEN {d.rlike(x, CYRILLIC)} THEN {out} ELSE lower({x}) END"


def canonical_word(word: str) -> str:
    """The same for a word of a fixed list, which has one script."""
    word = word.lower()
    for a in profiles.APOSTROPHES:
        word = word.replace(a, "'")
    for a, b in profiles.TRANSLIT_MANY:
        word = word.replace(a, b)
    return word.translate(str.maketrans(*profiles.TRANSLIT_ONE))


def is_formula(d: Dialect, x: str) -> str:
    compact = f"replace({x}, ' ', '')"
    signs = "[-+−*/^_∑∫√≈≠≤≥×÷±∞∂∆∇αβγδεθλμπσφω(){}\\[\\]|<>0-9.,=]"
    return f"(length({x}) <= 400 AND {d.rlike(x, '[=∑∫]')} AND CAST({d.rcount(compact, signs)} AS DOUBLE) / greatest(1, length({compact})) > 0.35 AND {d.rcount(x, '[\\p{L}\\p{Nl}\\p{No}]{3,}')} <= 6)"


def heading(d: Dialect, x: str) -> str:
    """Whether a line is a numbered heading, a chapter, or a heading by its word."""
    low = f"lower({x})"
    return f"(length({x}) < 120 AND ({d.rlike(low, '^(chapter|глава|bob) +([ivxlc]+|[0-9]+)')} OR {d.rlike(x, '^(§ *)?[0-9]+([.][0-9]+)*[.)]? +[A-ZА-ЯЁЎҚҒҲ][^.!?]*$')} OR {d.rlike(low, profiles.HEADING_WORDS)}))"


def blocks(d: Dialect, para: str) -> str:
    """doc_id, idx, disp, reason: why a line takes no part in the comparison (null: it does)."""
    disp = display(d, "text")
    over = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT doc_id, idx, disp, CASE WHEN {d.rlike('disp', '^[|].*[|]$')} THEN 'tables' WHEN max(CASE WHEN ref THEN idx END) {over} > coalesce(max(CASE WHEN head AND NOT ref THEN idx END) {over}, -1) THEN 'references'
        WHEN formula THEN 'formulas' END AS reason FROM (SELECT doc_id, idx, disp, {heading(d, 'disp')} AS head, {d.rlike('lower(disp)', profiles.REFERENCES_HEADING)} AS ref, {is_formula(d, 'disp')} AS formula
        FROM (SELECT doc_id, idx, {disp} AS disp FROM {para}) y) z"""


def _pieces(d: Dialect) -> tuple[str, str, str]:
    """disp with a quote, and the citation that follows it at once, between marks; the quote of its p-th piece, and what comes after it."""
    marked = d.rr("disp", f"({profiles.QUOTE})({profiles.CITED_AFTER})?", "\x01$1\x02$2\x03")
    head, tail = d.split("piece", "\x02"), f"coalesce(replace({d.at(d.split('piece', chr(2)), 2)}, {d.lit(chr(3))}, ''), '')"
    return marked, f"CASE WHEN p = 0 THEN '' ELSE coalesce({d.at(head, 1)}, '') END", f"CASE WHEN p = 0 THEN piece ELSE {tail} END"


def marked_line(d: Dialect, x: str) -> str:
    """A line for a reader that knows what blocks() makes of those before: r (references), h (another heading) or a blank; x
    (table or formula) or a blank; then each of its words as in stream(), after a blank."""
    marked, quote, after = _pieces(d)
    pieces = d.transform(d.split(marked, chr(1)), "(piece, p)", d.concat_arrays(d.rall(quote, profiles.WORD), d.rall(after, profiles.WORD)))
    said = d.join(d.transform(d.flat(pieces), "token", f"concat(' ', {canonical(d, 'token')})"), "")
    mark = f"CASE WHEN {d.rlike('lower(disp)', profiles.REFERENCES_HEADING)} THEN 'r' WHEN {heading(d, 'disp')} THEN 'h' ELSE ' ' END"
    left_out = f"({d.rlike('disp', '^[|].*[|]$')} OR {is_formula(d, 'disp')})"
    line = f"concat({mark}, CASE WHEN {left_out} THEN 'x' ELSE concat(' ', {said}) END)"
    return d.entry(d.transform(d.list_(display(d, x)), "disp", line), "1")


def stream(d: Dialect, blocks_: str) -> str:
    """doc_id, idx, pos, word (canonical), quoted, cited of every token that is compared, in order."""
    marked, quote, after = _pieces(d)
    cited = f"(p > 0 AND NOT coalesce({d.at(d.split('piece', chr(2)), 2)}, '') LIKE {d.lit(chr(3) + '%')})"
    return f"""SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, p, i) - 1 AS INT) AS pos, {canonical(d, 'token')} AS word, i < nq AS quoted, i < nq AND cited AS cited FROM (
        {d.explode_with('doc_id, idx, p, nq, cited', d.concat_arrays('quote_words', 'after_words'), 'token', 'i')} FROM (
        SELECT doc_id, idx, p, cited, {d.rall('quote', profiles.WORD)} AS quote_words, {d.rall('after', profiles.WORD)} AS after_words, {d.rcount('quote', profiles.WORD)} AS nq FROM (
        SELECT doc_id, idx, p, {quote} AS quote, {after} AS after, {cited} AS cited FROM (
        {d.explode_with('doc_id, idx', d.split(marked, chr(1)), 'piece', 'p')} FROM {blocks_} WHERE reason IS NULL) a) b) c) e"""


def words(d: Dialect, source: str, key: str) -> str:
    """key, pos, word (canonical) of all tokens of source(key, text)."""
    return f"SELECT {key}, pos, {canonical(d, 'token')} AS word FROM ({d.explode_with(key, d.rall(display(d, 'text'), profiles.WORD), 'token', 'pos')} FROM {source}) z"
