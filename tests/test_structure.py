"""Headings, sections and references of the made-up thesis, read by hand."""

from folioscope.plans import catalog, queries_structure

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r for r in catalog.QUERIES[name](spark, DATA).collect() if r.doc_id == -1]


def test_headings_and_sections(spark):
    at = queries_structure.THESIS.index
    got = {r.idx: (r.level, r.kind) for r in rows(spark, "m6_headings")}
    assert got == {
        1: (1, "toc"), 7: (1, "introduction"), 9: (1, "chapter"), 10: (2, "section"), 12: (3, "subsection"), 14: (2, "section"), 16: (2, "section"), 19: (2, "section"), 20: (1, "conclusion"),
        22: (1, "references"),
    }
    assert at("2.5 million pupils were counted.") not in got and rows(spark, "f17_toc_region")[0].last_entry == 5
    tree = {r.idx: r.parent for r in rows(spark, "m8_section_tree")}
    assert tree[10] == tree[14] == tree[16] == tree[19] == 9 and tree[12] == 10 and tree[20] is None
    ends = {r.idx: (r.own_end, r.section_end) for r in rows(spark, "f9_section_ends")}
    assert ends[9] == (10, 20) and ends[10] == (12, 14) and ends[12] == (14, 14) and ends[22] == (None, None)


def test_citations_and_references(spark):
    assert {r.number for r in rows(spark, "b31_cited_numbers")} == {1, 2, 3, 4, 5, 7}
    assert {(r.number, r.status) for r in rows(spark, "d21_citations_and_references")} == {(7, "missing"), (6, "uncited")}
    refs = {r.idx: r for r in rows(spark, "m15_references")}
    assert [i for i, r in sorted(refs.items()) if r.missing_year] == [25] and [i for i, r in sorted(refs.items()) if r.duplicate] == [23, 27]
    assert [(r.idx, r.a, r.b) for r in rows(spark, "m16_numbering_gaps")] == [(14, 1, 3)]
