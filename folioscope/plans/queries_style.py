"""Stylometry: language, sentences, signals, sub-scores, the combined score, shifts and histograms.

All signals of a document come from arrays within its row (words, sentences, windows), so that one pass over the documents
without a shuffle gives them all. What depends on the language goes by the profile of the language detected.
"""

from __future__ import annotations

import re

from folioscope.functions import profiles
from folioscope.operators.canonical import display
from folioscope.plans.dialect import Dialect

SHARED: dict = {}
LANGUAGES = ("uz", "ru", "en")
NOT_WORD = "[^\\p{L}\\p{N}_]"


def q(name: str, *bases: str):
    def add(build):
        SHARED[name] = (bases, build)
        return build

    return add


def among(d: Dialect, words: list[str]) -> str:
    return ", ".join(d.lit(w) for w in words)


def either(words: list[str]) -> str:
    """Any of the phrases, longest first."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\№", "№") for w in sorted(set(words), key=lambda w: (-len(w), w)))


def by_language(d: Dialect, build, otherwise: str = "NULL") -> str:
    return "CASE code " + " ".join(f"WHEN '{c}' THEN {build(c)}" for c in LANGUAGES) + f" ELSE {otherwise} END"


def detected(d: Dialect, source: str, key: str, keep: str = "") -> str:
    """key, w (lower-case words), n, code, confidence of every text of source(key, text)."""
    t = f"lower({display(d, 'text')})"
    count = lambda test: f"CAST({d.size(d.filter('w', 'x', test))} AS DOUBLE)"
    hits = ", ".join(f"{count('x IN (' + among(d, profiles.STOP[c]) + ')')} AS hits_{c}" for c in LANGUAGES)
    share = {"uz": "lat", "ru": "cyr", "en": "lat"}
    score = {c: f"{share[c]} / greatest(1, lat + cyr) * hits_{c} / greatest(1, n)" for c in LANGUAGES}
    score["uz"] += " + CAST(0.5 AS DOUBLE) * marks / greatest(1, n) * lat / greatest(1, lat + cyr)"
    best = "CASE WHEN s_uz >= s_ru AND s_uz >= s_en THEN 'uz' WHEN s_ru >= s_en THEN 'ru' ELSE 'en' END"
    top, low = "greatest(s_uz, s_ru, s_en)", "least(s_uz, s_ru, s_en)"
    second = f"(s_uz + s_ru + s_en - {top} - {low})"
    return f"""SELECT {key}, {keep} w, n, CASE WHEN n < 3 OR other OR {top} < 0.05 THEN 'unknown' ELSE {best} END AS code,
        CASE WHEN n < 3 THEN CAST(0 AS DOUBLE) WHEN other THEN CAST(0.5 AS DOUBLE) WHEN {top} < 0.05 THEN CAST(0 AS DOUBLE) ELSE round(least(CAST(1 AS DOUBLE), ({top} - {second}) / {top} + least(n, 200) / CAST(1000 AS DOUBLE)), 3) END AS confidence FROM (
        SELECT {key}, {keep} w, n, uzc > 0 AND cyr > 0.5 * greatest(1, lat + cyr) AS other, {', '.join(f'{v} AS s_{c}' for c, v in score.items())} FROM (
        SELECT {key}, {keep} w, n, lat, cyr, uzc, {hits}, {count(d.rlike('x', profiles.UZ_ENDINGS))} AS marks FROM (
        SELECT {key}, {keep} w, {d.size('w')} AS n, CAST({d.rcount('t', '[a-z]')} AS DOUBLE) AS lat, CAST({d.rcount('t', '[а-яё]')} AS DOUBLE) AS cyr, {d.rcount('t', '[ўқғҳ]')} AS uzc FROM (
        SELECT {key}, {keep} t, {d.hold(d.rall('t', profiles.WORD), 'w')} FROM (SELECT {key}, {keep} {t} AS t FROM {source} WHERE text IS NOT NULL) l0) l1) l2) l3) l4"""


def sentences(d: Dialect, t: str) -> str:
    """Array of the sentences of a text in one line; initials and abbreviations end none."""
    def guarded(c: str) -> str:
        stop = f"(?i)(^|[\\s(«\"'\x1d])((?:[\\p{{L}}][.])|(?:{either(profiles.ABBREVIATIONS.get(c, []))}))\\s+" if c in LANGUAGES else "(?i)(^|[\\s(«\"'\x1d])([\\p{L}][.])\\s+"
        return d.rr(d.rr(t, stop, "$1$2\x1d"), stop, "$1$2\x1d")

    whole = by_language(d, guarded, guarded("unknown"))
    return d.transform(d.split(d.rr(whole, profiles.SENTENCE_END, "$1\x1e$2"), "\x1e"), "x", f"replace(x, {d.lit(chr(29))}, ' ')")


def repeated(d: Dialect, array: str) -> str:
    """How many entries of a sorted array stand there more than once."""
    here, before, after = d.entry(array, "i"), d.entry(array, "(i - 1)"), d.entry(array, "(i + 1)")
    # entry 0 is none in either engine: the test of i keeps one engine from counting it from the end
    return d.size(d.filter(d.numbers("1", d.size(array)), "i", f"(i > 1 AND coalesce({here} = {before}, FALSE)) OR coalesce({here} = {after}, FALSE)"))


def spread(d: Dialect, array: str) -> tuple[str, str]:
    """Mean and sample standard deviation (0 of less than two)."""
    n, s = f"greatest(1, {d.size(array)})", d.total(array)
    squares = d.total(d.transform(array, "x", "x * x"))
    return f"({s} / {n})", f"CASE WHEN {d.size(array)} < 2 THEN CAST(0 AS DOUBLE) ELSE sqrt(greatest(CAST(0 AS DOUBLE), {squares} - {s} * {s} / {n}) / greatest(1, {n} - 1)) END"


def features(d: Dialect) -> str:
    """One row a document with its words, sentences and all signals (null where there is too little of it)."""
    line = f"trim({d.rr(display(d, 'text'), '\\s+', ' ')})"
    words_of = lambda x: d.rall(x, profiles.WORD)
    length = f"CAST({d.rcount('x', profiles.WORD)} AS DOUBLE)"
    shape = d.transform(words_of("lower(x)"), "t", f"CASE WHEN {by_language(d, lambda c: f't IN ({among(d, profiles.STOP[c])})', 'FALSE')} THEN t ELSE '#' END")
    grams = d.flat(d.transform("shapes", "y", d.transform(d.numbers("1", f"{d.size('y')} - 3"), "i", d.join(d.slice("y", "i", "4"), " "))))
    ttr = d.transform(d.numbers("0", d.idiv("n - 40", "20")), "o", f"CAST({d.size(d.distinct(d.slice('w', '(o * 20 + 1)', '40')))} AS DOUBLE) / 40")
    mattr = d.transform(d.numbers("0", d.idiv("n - 50", "10")), "o", f"CAST({d.size(d.distinct(d.slice('w', '(o * 10 + 1)', '50')))} AS DOUBLE) / 50")
    opening = d.transform("s", "x", f"lower({d.rx('x', profiles.WORD)})")
    caps = d.size(d.filter(d.flat(d.transform("s", "x", d.slice(words_of("x"), "2", "greatest(" + d.size(words_of("x")) + " - 1, 0)"))), "t", d.rlike("t", "^\\p{Lu}.")))
    starts = lambda c: d.size(d.filter("s", "x", d.rlike(d.rr("lower(x)", "^[\"'«“(\\[ ]+", ""), f"^(?:{either(profiles.TRANSITIONS[c])})(?:$|[^\\p{{L}}\\p{{N}}])")))
    generic = lambda c: d.rcount("lower(t)", f"(?:^|{NOT_WORD})(?:{either(profiles.GENERIC[c])})(?:$|{NOT_WORD})")
    formal = lambda c: d.size(d.filter("w", "x", f"length(x) > 5 AND {d.rlike('x', profiles.FORMAL[c])}"))
    quality = lambda c: d.size(d.filter("w", "x", d.rlike("x", "^(?:" + "|".join([either([p for p in profiles.QUALIFIERS[c] if len(p) >= 5]), *(f"{p}$" for p in profiles.QUALIFIERS[c] if len(p) < 5)]) + ")")))
    academic = lambda c: d.size(d.filter("w", "x", d.rlike("x", f"^(?:{either(profiles.ACADEMIC[c])})")))
    unit = "[\\p{L}\\p{N}_]+"
    triads = lambda c: d.rcount("t", f"(?i){unit}(?:\\s{unit})?,\\s+{unit}(?:\\s{unit})?,?\\s+{profiles.AND[c]}\\s+{unit}")
    long_ = "CASE code " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in profiles.LONG_SENTENCE.items()) + " ELSE 40 END"
    mean, std = spread(d, "lens")
    t_mean, t_std = spread(d, "ttrs")
    p_mean, p_std = spread(d, "paras")
    per = "CAST(100 AS DOUBLE) / greatest(1, n)"
    spec = f"{d.rcount('t', profiles.NUMBER)} + 2 * {d.rcount('t', profiles.CITATION)} + {d.rcount('t', '[(][^()][^()]+[)]')} + {d.rcount('t', '[«»“”\"]')} / CAST(2 AS DOUBLE) + {caps}"
    return f"""SELECT doc_id, source, code, confidence AS code_confidence, n, w, s, lens, ttrs, mattrs, m AS n_sentences, long_n, academic_n, {mean} AS mean_sentence_length,
        CASE WHEN m >= 4 THEN {std} / {mean} END AS sentence_length_cv, generic_n * {per} AS generic_phrase_density, CASE WHEN m >= 3 THEN CAST(starts_n AS DOUBLE) / m END AS transition_start_ratio,
        CASE WHEN m >= 4 THEN CAST({repeated(d, 'firsts')} AS DOUBLE) / m END AS opening_repetition, CASE WHEN m >= 4 AND {d.size('grams')} >= 10 THEN CAST({repeated(d, 'grams')} AS DOUBLE) / {d.size('grams')} END AS template_repetition,
        CASE WHEN n > 0 THEN spec * {per} END AS specificity_density, CASE WHEN {d.size('ttrs')} >= 3 THEN {t_std} END AS lexical_uniformity, CASE WHEN m >= 3 THEN CAST(triads AS DOUBLE) / m END AS triad_density,
        formal_n * {per} AS formalization_density, quality_n * {per} AS qualifier_density, CASE WHEN {d.size('paras')} >= 4 THEN {p_std} / {p_mean} END AS paragraph_uniformity FROM (
        SELECT doc_id, source, code, confidence, n, w, s, m, lens, paras, ttrs, mattrs, generic_n, starts_n, spec, triads, formal_n, quality_n, academic_n, {d.size(d.filter('lens', 'x', f'x > {long_}'))} AS long_n, {d.sorted(opening)} AS firsts,
            {d.sorted(d.filter(grams, 'g', f"{d.rcount('g', '#')} <= 2"))} AS grams FROM (
        SELECT doc_id, source, code, confidence, n, w, s, {d.size('s')} AS m, {d.transform('s', 'x', length)} AS lens, {d.filter(d.transform(d.split('text', chr(10)), 'x', length), 'x', 'x > 0')} AS paras,
            CASE WHEN n >= 80 THEN {ttr} ELSE {d.filter(ttr, 'x', 'FALSE')} END AS ttrs, {mattr} AS mattrs, {by_language(d, generic)} AS generic_n, {by_language(d, starts)} AS starts_n, {spec} AS spec, {by_language(d, triads)} AS triads,
            {by_language(d, formal)} AS formal_n, {by_language(d, quality)} AS quality_n, {by_language(d, academic, '0')} AS academic_n, {d.transform('s', 'x', shape)} AS shapes FROM (
        SELECT doc_id, source, text, t, code, confidence, n, w, {d.hold(d.filter(sentences(d, 't'), 'x', f"{d.rcount('x', profiles.WORD)} >= 3"), 's')} FROM (
        SELECT doc_id, source, text, {line} AS t, code, confidence, n, w FROM ({detected(d, d.t('documents'), 'doc_id', 'source, text,')}) f0) f1) f2) f3) f4"""


SIGNALS = {
    "l2_sentence_length_cv": "sentence_length_cv",
    "l3_generic_phrase_density": "generic_phrase_density",
    "l4_transition_start_ratio": "transition_start_ratio",
    "l5_opening_repetition": "opening_repetition",
    "l6_template_repetition": "template_repetition",
    "l7_specificity_density": "specificity_density",
    "l8_lexical_uniformity": "lexical_uniformity",
    "l9_triad_density": "triad_density",
    "l10_formalization_density": "formalization_density",
    "l11_qualifier_density": "qualifier_density",
    "l12_paragraph_uniformity": "paragraph_uniformity",
}
for _name, _signal in SIGNALS.items():
    SHARED[_name] = ((), lambda d, s=_signal: f"SELECT doc_id, round(v, 6) AS v FROM (SELECT doc_id, {d.hold(s, 'v')} FROM ({features(d)}) y) z WHERE v IS NOT NULL")


@q("l1_features")
def _(d):
    return f"SELECT doc_id, code, n, n_sentences, round(mean_sentence_length, 6) AS mean_sentence_length, {', '.join(f'round({s}, 6) AS {s}' for s in SIGNALS.values())} FROM ({features(d)}) z"


def scored(d: Dialect) -> str:
    """The features, a sub-score for each signal, and the score: null below 40 words or three signals."""

    def sub(signal: str) -> str:
        mid, scale, direction, _ = profiles.BASELINES[signal]
        cases = " ".join(f"WHEN '{c}' THEN {direction} * ({signal} - {m}) / CAST({k} AS DOUBLE)" for c, (m, k) in ((c, v[signal]) for c, v in profiles.BASELINES_OF.items() if signal in v))
        plain = f"{direction} * ({signal} - {mid}) / CAST({scale} AS DOUBLE)"
        z = f"CASE code {cases} ELSE {plain} END" if cases else plain
        return f"1 / (1 + exp(-greatest(-50, least(50, {z}))))"

    weight = {s: profiles.BASELINES[s][3] for s in SIGNALS.values()}
    sums = " + ".join(f"coalesce({weight[s]} * s_{s}, 0)" for s in weight)
    total = " + ".join(f"CASE WHEN s_{s} IS NULL THEN 0 ELSE CAST({weight[s]} AS DOUBLE) END" for s in weight)
    number = lambda test: " + ".join(f"CASE WHEN {test.format(s=f's_{s}')} THEN 1 ELSE 0 END" for s in weight)
    subs = ", ".join(f"CASE WHEN n >= 40 THEN {sub(s)} END AS s_{s}" for s in weight)
    names = ", ".join(f"s_{s}" for s in weight)
    return f"""SELECT doc_id, source, code, n, signals, {names}, score, for_, against FROM (
        SELECT doc_id, source, code, n, signals, {names}, score, {number('abs({s} - 0.5) > 0.15 AND ({s} - 0.5) * CASE WHEN score >= 50 THEN 1 ELSE -1 END > 0')} AS for_, {number('abs({s} - 0.5) > 0.15')} AS against FROM (
        SELECT doc_id, source, code, n, signals, {names}, {d.hold(f'CASE WHEN n >= 40 AND signals >= 3 THEN 100 * ({sums}) / ({total}) END', 'score')} FROM (
        SELECT doc_id, source, code, n, {names}, {number('{s} IS NOT NULL')} AS signals FROM (SELECT doc_id, source, code, n, {subs} FROM ({features(d)}) s0) s1) s2) s3) s4"""


def each_signal(d: Dialect) -> str:
    rows = d.list_(*(d.row(signal=f"'{s}'", sub=f"s_{s}") for s in SIGNALS.values()))
    return f"SELECT doc_id, e.signal AS signal, e.sub AS sub FROM (SELECT doc_id, {d.explode(rows)} AS e FROM ({scored(d)}) e0) e1 WHERE e.sub IS NOT NULL"


@q("l13_subscores")
def _(d):
    return f"SELECT doc_id, signal, round(sub, 6) AS sub FROM ({each_signal(d)}) z"


@q("l14_style_score")
def _(d):
    return f"SELECT doc_id, n AS words, signals, round(score, 4) AS score FROM ({scored(d)}) z"


def confidence() -> str:
    order = "CASE WHEN n >= 150 AND abs(score - 50) >= 22 AND agreement >= 0.75 AND signals >= 7 THEN 2 WHEN n >= 80 AND abs(score - 50) >= 10 AND agreement >= 0.6 THEN 1 ELSE 0 END"
    cap = "CASE code " + " ".join(f"WHEN '{c}' THEN {('low', 'medium', 'high').index(v)}" for c, v in profiles.MOST_CONFIDENCE.items()) + " END"
    return f"CASE WHEN score IS NULL THEN 0 ELSE least({order}, {cap}) END"


def passages(d: Dialect) -> str:
    return f"SELECT doc_id, source, code, n, signals, score, {confidence()} AS level FROM (SELECT doc_id, source, code, n, signals, score, CASE WHEN against > 0 THEN CAST(for_ AS DOUBLE) / against ELSE 0 END AS agreement FROM ({scored(d)}) p0) p1"


LEVEL = "CASE level WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


@q("l15_confidence")
def _(d):
    return f"SELECT doc_id, {LEVEL} AS confidence FROM ({passages(d)}) z"


@q("l17_passage_scores")
def _(d):
    return f"SELECT doc_id, code, n AS words, round(score, 1) AS score, {LEVEL} AS confidence FROM ({passages(d)}) z"


@q("l16_characteristics")
def _(d):
    return f"SELECT doc_id, {d.agg_text('signal', ',', 'k')} AS characteristics FROM (SELECT doc_id, signal, row_number() OVER (PARTITION BY doc_id ORDER BY round(sub, 6) DESC, signal) AS k FROM ({each_signal(d)}) y WHERE sub >= 0.68) z GROUP BY doc_id"


@q("l22_score_bands")
def _(d):
    return f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score IS NULL THEN 'none' ELSE 'low' END AS band FROM ({scored(d)}) y) z GROUP BY band"


@q("e8_confidence_medians")
def _(d):
    """Lower median of the levels of a source; low below 300 words."""
    return f"""SELECT source, CASE WHEN words < 300 THEN 'low' ELSE {LEVEL} END AS confidence FROM (SELECT source, level, sum(n) OVER (PARTITION BY source) AS words, row_number() OVER (PARTITION BY source ORDER BY level, doc_id) AS k, count(*) OVER (PARTITION BY source) AS m
    FROM ({passages(d)}) y WHERE score IS NOT NULL) z WHERE k = {d.idiv('m + 1', '2')}"""


@q("e9_document_scores")
def _(d):
    ladder = "CASE WHEN words >= 3000 AND n >= 20 AND sure >= 0.6 THEN 'high' WHEN words >= 800 AND n >= 8 AND sure >= 0.3 THEN 'medium' ELSE 'low' END"
    return f"""SELECT source, round(score, 4) AS score, words, n, {ladder} AS confidence FROM (SELECT source, sum(score * n) / sum(n) AS score, sum(n) AS words, count(*) AS n, avg(CASE WHEN level >= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS sure
    FROM ({passages(d)}) y WHERE score IS NOT NULL GROUP BY source) z"""


@q("e10_score_histogram")
def _(d):
    return f"SELECT b.bin, count(c.doc_id) AS n FROM (SELECT {d.explode(d.series('0', '9'))} AS bin) b LEFT JOIN ({scored(d)}) c ON least(9, CAST(floor(c.score / 10) AS INT)) = b.bin GROUP BY b.bin"


@q("e17_mattr")
def _(d):
    return f"SELECT doc_id, round(CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) WHEN n <= 50 THEN CAST({d.size(d.distinct('w'))} AS DOUBLE) / n ELSE {d.total('mattrs')} / {d.size('mattrs')} END, 9) AS mattr FROM ({features(d)}) z"


@q("e18_window_ttrs")
def _(d):
    return f"SELECT doc_id, {d.explode('ttrs')} AS ttr FROM ({features(d)}) z"


@q("m11_long_sentences")
def _(d):
    return f"SELECT doc_id, n_sentences AS n, long_n, CAST(long_n AS DOUBLE) / n_sentences > 0.25 AS many FROM ({features(d)}) z WHERE n_sentences > 0"


@q("m12_academic_words")
def _(d):
    return f"SELECT doc_id, round(CAST(academic_n AS DOUBLE) / n, 6) AS share FROM ({features(d)}) z WHERE n > 0"


@q("b5_sentences")
def _(d):
    return f"SELECT doc_id, n_sentences AS n, md5({d.join('s', '|')}) AS h FROM ({features(d)}) z"


@q("m1_language", "para")
def _(d):
    return f"SELECT doc_id, idx, code, confidence FROM ({detected(d, d.t('para'), 'doc_id, idx')}) z"


@q("m2_language_distribution", "para")
def _(d):
    return f"SELECT doc_id, code, words, round(CAST(words AS DOUBLE) / sum(words) OVER (PARTITION BY doc_id), 4) AS share FROM (SELECT doc_id, code, sum(n) AS words FROM ({detected(d, d.t('para'), 'doc_id, idx')}) y WHERE n >= 5 GROUP BY doc_id, code) z"


@q("e13_dominant_language", "para")
def _(d):
    return f"""SELECT doc_id, code, round(round(CAST(words AS DOUBLE) / total, 4) * sure / words, 3) AS confidence FROM (SELECT doc_id, code, words, sure, sum(words) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, code) AS k
    FROM (SELECT doc_id, code, sum(n) AS words, sum(n * confidence) AS sure FROM ({detected(d, d.t('para'), 'doc_id, idx')}) x WHERE n >= 5 GROUP BY doc_id, code) y) z WHERE k = 1"""


@q("e16_robust_median")
def _(d):
    """Upper median of the words of a source's documents, and its spread: the median deviation, or else the standard deviation."""
    middle = d.idiv("m", "2") + " + 1"
    return f"""SELECT source, med, CASE WHEN mad > 0.000000001 THEN mad WHEN std > 0 THEN std ELSE 1 END AS scale FROM (SELECT source, max(med) AS med, max(CASE WHEN k2 = {middle} THEN dev * 1.4826 END) AS mad, round(max(std), 6) AS std FROM (
    SELECT source, m, med, std, abs(n - med) AS dev, row_number() OVER (PARTITION BY source ORDER BY abs(n - med), doc_id) AS k2 FROM (SELECT source, doc_id, n, m, max(CASE WHEN k = {middle} THEN n END) OVER (PARTITION BY source) AS med, coalesce(stddev_samp(n) OVER (PARTITION BY source), 0) AS std FROM (
    SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS k, count(*) OVER (PARTITION BY source) AS m FROM ({features(d)}) x WHERE n > 0) y) z) v GROUP BY source) u"""


@q("e31_cohesion", "sent")
def _(d):
    return f"""WITH w AS (SELECT DISTINCT doc_id, k, substr(word, 1, 5) AS stem FROM (SELECT doc_id, k, {d.explode(d.rall('lower(sentence)', '[a-zà-öø-ÿ]+'))} AS word FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, n) AS k, sentence FROM {d.t('sent')}) s) z WHERE length(word) > 3),
    c AS (SELECT doc_id, k, count(*) AS n FROM w GROUP BY doc_id, k), b AS (SELECT a.doc_id, a.k, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k = a.k + 1 AND a.stem = b.stem GROUP BY a.doc_id, a.k)
    SELECT x.doc_id, round(avg(CAST(coalesce(b.n, 0) AS DOUBLE) / (x.n + y.n - coalesce(b.n, 0))), 6) AS cohesion FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.k = x.k + 1 LEFT JOIN b ON b.doc_id = x.doc_id AND b.k = x.k GROUP BY x.doc_id"""


@q("f5_adjacent_shift", "ptok")
def _(d):
    return f"""WITH p AS (SELECT doc_id, idx, count(*) AS words, avg(length(word)) AS mean_length FROM {d.t('ptok')} GROUP BY doc_id, idx), n AS (SELECT doc_id, idx, lead(idx) OVER w AS next_idx, mean_length, lead(mean_length) OVER w AS next_length FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, idx, next_idx, round(abs(next_length - mean_length), 6) AS shift FROM n WHERE next_idx IS NOT NULL"""
