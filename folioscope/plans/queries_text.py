"""Scalar text functions, language, structure, academic and integrity checks."""

from __future__ import annotations

from folioscope.functions import profiles
from folioscope.operators.canonical import is_formula
from folioscope.plans.dialect import Dialect

SHARED: dict = {}


def q(name: str, *bases: str):
    def add(build):
        SHARED[name] = (bases, build)
        return build

    return add


def values(d: Dialect, name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of seed rows."""
    body = ", ".join("(" + ", ".join(d.lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS {name}_seed({columns}))"


SEED_WORDS = [(1, "Kitob"), (2, "Китоб"), (3, "kit​ob"), (4, "Ўқувчи"), (5, "oʻquvchi"), (6, "cтатья"), (7, "ёлка"), (8, "школа"), (9, "maʼno"), (10, "pасчёт"), (11, "щит"), (12, "ночь")]
SEED_FILES = [(1, "report (1).docx"), (2, "Report.docx"), (3, "my_thesis-copy.pdf"), (4, "my thesis.pdf"), (5, "nusxa.txt")]
SEED_DOIS = [(1, "https://doi.org/10.1/AB"), (2, "doi: 10.2/x"), (3, "http://dx.doi.org/10.3/Y"), (4, " 10.4/z ")]
SEED_URLS = [(8, "http://[::1]/a"), (9, "http://100.64.3.2/"), (10, "https://a.uz:443/x"), (11, "http://LOCALHOST/"), (1, "http://8.8.8.8/a"), (2, "http://10.0.0.1/a"), (3, "https://lex.uz/docs/1"), (4, "https://sub.lex.uz/x"), (5, "ftp://a.b/c"), (6, "http://192.168.1.4:8080/"), (7, "https://notlex.uz/")]


def canonical(d: Dialect, x: str) -> str:
    """Apostrophes, look-alikes by dominant script, lower case, transliteration."""
    for a in profiles.APOSTROPHES:
        x = f"replace({x}, {d.lit(a)}, {d.lit(chr(39))})"
    x = f"translate({x}, {d.lit(profiles.INVISIBLE)}, '')"
    lat, cyr = d.rcount(x, "[a-zA-Z]"), d.rcount(x, "[а-яёА-ЯЁўқғҳЎҚҒҲіјѕһІЈЅ]")
    fixed = f"CASE WHEN {lat} > 0 AND {cyr} > 0 AND {cyr} >= {lat} THEN translate({x}, {d.lit(profiles.LAT_BACK)}, {d.lit(profiles.CYR_BACK)}) WHEN {lat} > 0 AND {cyr} > 0 THEN translate({x}, {d.lit(profiles.CYR_LOOK)}, {d.lit(profiles.LAT_LOOK)}) ELSE {x} END"
    out = f"lower({fixed})"
    for a, b in profiles.TRANSLIT_MANY:
        out = f"replace({out}, {d.lit(a)}, {d.lit(b)})"
    return f"translate({out}, {d.lit(profiles.TRANSLIT_ONE[0])}, {d.lit(profiles.TRANSLIT_ONE[1])})"


@q("b12_canonical_word")
def _(d):
    return f"WITH {values(d, 'w', 'id, word', SEED_WORDS)} SELECT id, {canonical(d, 'word')} AS canonical FROM w"


@q("b8_strip_invisible")
def _(d):
    return f"WITH {values(d, 'w', 'id, word', SEED_WORDS)} SELECT id, length(word) AS before_n, length(translate(word, {d.lit(profiles.INVISIBLE)}, '')) AS after_n FROM w"


@q("b2_collapse_spaces")
def _(d):
    return f"SELECT doc_id, md5(trim({d.rr('text', '[ \\n\\t\\r]+', ' ')})) AS h FROM {d.t('documents')}"


@q("b3_words", "tok")
def _(d):
    return f"SELECT doc_id, count(*) AS n, count(DISTINCT word) AS n_distinct, sum(length(word)) AS letters FROM {d.t('tok')} GROUP BY doc_id"


@q("b6_text_hash")
def _(d):
    return f"SELECT doc_id, {d.sha('lower(trim(' + d.rr('text', '[ \\n\\t\\r]+', ' ') + '))')} AS h FROM {d.t('documents')}"


@q("b16_file_names")
def _(d):
    stem = d.rr("lower(name)", "[.][a-z0-9]+$", "")
    bare = d.rr(d.rr(d.rr(stem, " ?[(][0-9]+[)]$", ""), "[-_ ]*(copy|nusxa)$", ""), "[-_ ]+", " ")
    return f"WITH {values(d, 'f', 'id, name', SEED_FILES)} SELECT id, trim({bare}) AS bare FROM f"


@q("b17_edge_keys", "para")
def _(d):
    return f"SELECT doc_id, idx, {d.rr('text', '[0-9]+', '#')} AS edge_key FROM {d.t('para')} WHERE length(text) < 60"


@q("b18_formulas", "para")
def _(d):
    return f"SELECT doc_id, idx, {is_formula(d, 'text')} AS formula FROM {d.t('para')} WHERE {d.rlike('text', '[=∑∫]')}"


@q("b21_years", "para")
def _(d):
    return f"SELECT doc_id, idx, {d.rx('text', profiles.YEAR)} AS year FROM {d.t('para')} WHERE {d.rlike('text', profiles.YEAR)}"


@q("b22_doi")
def _(d):
    bare = d.rr(d.rr("trim(lower(doi))", "^(https?://)?(dx[.])?doi[.]org/", ""), "^doi: *", "")
    return f"WITH {values(d, 's', 'id, doi', SEED_DOIS)} SELECT id, {bare} AS doi FROM s"


@q("bare_urls")
def _(d):
    return f"SELECT page_id, lower({d.rr('url', '^https?://(www[.])?', '')}) AS bare FROM {d.t('pages')}"


@q("b23_url_hosts")
def _(d):
    host = d.rx("url", "^[a-z]+://([^/:?#]+)", 1)
    return f"WITH {values(d, 'u', 'id, url', SEED_URLS)} SELECT id, {d.sha('url')} AS url_key, {host} AS host, ({host} = 'lex.uz' OR {host} LIKE '%.lex.uz') AS on_site FROM u UNION ALL SELECT CAST(page_id AS INT) + 1000, {d.sha('url')}, {host}, FALSE FROM {d.t('pages')}"


@q("a35_public_urls")
def _(d):
    """Web addresses on ports 80 and 443 whose host is no private, local or reserved one."""
    host, port = d.rx("url", "^[a-z]+://(\\[[^\\]]*\\]|[^/:?#]+)", 1), d.rx("url", "^[a-z]+://(?:\\[[^\\]]*\\]|[^/:]+):([0-9]+)", 1)
    private = d.rlike(f"lower({host})", "^(localhost$|0[.]|10[.]|127[.]|192[.]168[.]|192[.]0[.][02][.]|198[.]1[89][.]|169[.]254[.]|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|22[4-9][.]|2[345][0-9][.]|\\[(::1?|f[cd]|fe[89ab]))")
    return f"WITH {values(d, 'u', 'id, url', SEED_URLS)} SELECT id, url, ({d.rlike('url', '^https?://')} AND NOT {private} AND {port} IN ('', '80', '443')) AS allowed FROM u UNION ALL SELECT CAST(page_id AS INT) + 1000, url, ({d.rlike('url', '^https?://')} AND NOT {private} AND {port} IN ('', '80', '443')) FROM {d.t('pages')}"


@q("a15_text_scan", "para", "ptok")
def _(d):
    pages = d.idiv("greatest(sum(n) OVER (PARTITION BY doc_id ORDER BY idx) - n, 0)", "280")
    return f"WITH w AS (SELECT p.doc_id, p.idx, p.text, greatest(1, coalesce(t.n, 0)) AS n FROM {d.t('para')} p LEFT JOIN (SELECT doc_id, idx, count(*) AS n FROM {d.t('ptok')} GROUP BY doc_id, idx) t ON t.doc_id = p.doc_id AND t.idx = p.idx) SELECT doc_id, idx, n AS words, 1 + {pages} AS page FROM w"


@q("a16_page_text")
def _(d):
    bare = d.rr(d.rr("html", "(?is)<(script|style|noscript|nav|header|footer)[^>]*>.*?</(script|style|noscript|nav|header|footer)>", " "), "(?s)<[^>]*>", " ")
    return f"SELECT page_id, {d.rx('html', '(?is)<title>(.*?)</title>', 1)} AS title, length(trim({d.rr(bare, '[ \\n\\t\\r]+', ' ')})) AS n FROM {d.t('pages')}"


@q("a24_links")
def _(d):
    return f"SELECT page_id, link, count(*) AS n FROM (SELECT page_id, {d.explode(d.rall('html', 'href=\"[^\"]*\"'))} AS link FROM {d.t('pages')}) z GROUP BY page_id, link"


@q("a30_strip_tags")
def _(d):
    return f"SELECT page_id, md5(trim({d.rr('html', '<[^>]+>', ' ')})) AS h FROM {d.t('pages')}"


@q("a9_repeated_lines", "para")
def _(d):
    return f"SELECT edge_key, n_docs FROM (SELECT {d.rr('text', '[0-9]+', '#')} AS edge_key, count(DISTINCT doc_id) AS n_docs FROM {d.t('para')} WHERE length(text) < 200 GROUP BY {d.rr('text', '[0-9]+', '#')}) z WHERE n_docs >= 3"


@q("a11_split_paragraphs", "para")
def _(d):
    return f"""WITH p AS (SELECT doc_id, idx, text, CASE WHEN {d.rlike("lag(text) OVER w", "[a-z,]$")} AND {d.rlike('text', '^[a-z]')} THEN 0 ELSE 1 END AS starts FROM {d.t('para')} WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    g AS (SELECT doc_id, idx, text, sum(starts) OVER (PARTITION BY doc_id ORDER BY idx) AS block FROM p) SELECT doc_id, block, md5({d.agg_text('text', ' ', 'idx')}) AS h, count(*) AS n FROM g GROUP BY doc_id, block"""


@q("b28_json_dig")
def _(d):
    return f"SELECT event_id, {d.json('props', 'k')} AS k, {d.json('props', 'v')} AS v FROM {d.t('events')}"


@q("m18_formatting", "para")
def _(d):
    long_ = f"sum(CASE WHEN {d.rcount('text', profiles.WORD)} > 350 THEN 1 ELSE 0 END) AS long_paragraphs"
    return f"SELECT doc_id, {long_}, sum({d.rcount('text', '  +')}) AS double_spaces, sum(CASE WHEN {d.rcount('text', '[A-Z]')} > 10 AND text = upper(text) THEN 1 ELSE 0 END) AS all_caps, sum({d.rcount('text', '[«»]')}) AS angle_quotes, sum({d.rcount('text', '[“”]')}) AS curly_quotes FROM {d.t('para')} GROUP BY doc_id"


@q("m19_overused_words", "tok")
def _(d):
    among = ", ".join(d.lit(w) for w in profiles.STOP_EN)
    return f"""WITH c AS (SELECT doc_id, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM {d.t('tok')} GROUP BY doc_id, word),
    r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM c WHERE length(word) > 3 AND word NOT IN ({among}) AND n >= 8 AND CAST(n AS DOUBLE) / total > 0.008) SELECT doc_id, word, n FROM r WHERE k <= 15"""


@q("m19_repeated_sentences", "sent")
def _(d):
    return f"SELECT doc_id, md5(lower(trim(sentence))) AS h, count(*) AS n FROM {d.t('sent')} WHERE length(sentence) > 30 GROUP BY doc_id, md5(lower(trim(sentence))) HAVING count(*) > 1"


@q("m20_integrity")
def _(d):
    spaced, odd = "(?:^| )(?:[A-Za-z] ){4,}", "[ -   　]"
    return f"SELECT doc_id, {d.rcount('text', '[' + profiles.INVISIBLE + ']')} AS invisible, {d.rcount('text', spaced)} AS spaced_letters, {d.rcount('text', odd)} AS unusual_spaces, {d.rcount('text', '[а-яёА-ЯЁ]')} AS cyrillic FROM {d.t('documents')}"


@q("e32_spelling_variants", "tok")
def _(d):
    return f"""WITH h AS (SELECT {d.explode(d.rall('lower(text)', '[a-z]+-[a-z]+'))} AS form FROM {d.t('documents')}), c AS (SELECT form, replace(form, '-', '') AS joined, count(*) AS n FROM h GROUP BY form), w AS (SELECT word, count(*) AS n FROM {d.t('tok')} GROUP BY word)
    SELECT c.form, c.n AS hyphened, w.n AS joined_n FROM c JOIN w ON w.word = c.joined"""


@q("d20_undefined_abbreviations")
def _(d):
    used = d.explode(d.rall("text", "[A-Z][A-Z]+"))
    return f"WITH u AS (SELECT doc_id, {used} AS abbr FROM {d.t('documents')}), g AS (SELECT doc_id, abbr, count(*) AS n FROM u WHERE length(abbr) <= 6 GROUP BY doc_id, abbr) SELECT g.doc_id, g.abbr, g.n FROM g JOIN {d.t('documents')} x ON x.doc_id = g.doc_id WHERE g.n >= 2 AND NOT contains(x.text, concat('(', g.abbr, ')'))"


@q("k1_quotes", "para")
def _(d):
    whole = f"(?:{profiles.QUOTE})(?:{profiles.CITED_AFTER})?"
    return f"SELECT doc_id, idx, quote, {d.rlike('quote', '(?:' + profiles.CITED_AFTER + ')$')} AS cited FROM (SELECT doc_id, idx, {d.explode(d.rall('text', whole))} AS quote FROM {d.t('para')}) z"


@q("k14_quick_words")
def _(d):
    return f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE {d.rcount('text', '[^ \\n\\t\\r]+')} END AS n FROM {d.t('documents')}"


@q("f12_section_sample", "para")
def _(d):
    return f"SELECT doc_id, idx FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {d.t('para')}) z WHERE n <= 8 OR {d.idiv('k * 8', 'n')} <> {d.idiv('(k - 1 + n) * 8', 'n')} - 8"


@q("conversation_order")
def _(d):
    return f"SELECT conv_id, {d.agg_text('role', '>', 'turn')} AS roles, count(*) AS n, sum(length(text)) AS chars FROM {d.t('conversations')} GROUP BY conv_id"
