"""Near-duplicates, repeated passages and components, against plain versions."""

import random

import numpy as np

from faultline.llm import linking, near_dedup, substring_dedup
from faultline.llm.common import table
from faultline.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", "."]) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    edges += [(500, i) for i in range(501, 700)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 4)], "a long, b long")).collect()}
    assert got == {k: v for k, v in brute.components([e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def family(rng):
    rows = [(i, prose(rng, rng.randint(20, 80))) for i in range(30)]
    for i in range(30, 90):  # near copies, some far enough to be no link
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    return rows + [(90, rows[3][1].upper()), (91, rows[3][1]), (92, None), (93, ""), (94, "one"), (95, "ONE"), (96, " \n "), (97, "x " * 4000), (98, "x x")]


def test_near_duplicates(docs_of):
    rows = family(random.Random(5))
    for n in (2, 5):
        got = {r.doc_id: r for r in near_dedup.linked(docs_of(rows), shingle=n).collect()}
        assert {k: r.component_id for k, r in got.items()} == brute.linked(rows, n)
        assert {k: r.n_shingles for k, r in got.items()} == {i: len(brute.shingles(t, n)) for i, t in rows}


def test_one_of_each_group_stays(docs_of):
    rows = family(random.Random(6))
    kept = near_dedup.deduplicated(docs_of(rows + [rows[0]]))
    assert kept.columns == docs_of(rows).columns
    want = brute.linked(rows, 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in want if want[i] == i] + [rows[0][0]])
    assert near_dedup.linked(docs_of([])).collect() == []


def test_null_ids(docs_of):
    got = near_dedup.linked(docs_of([(None, "a b c d e f"), (None, "q r s"), (5, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_bands_reach_the_recall():
    b = substring_dedup.bands()
    assert 1 - (1 - 0.8**substring_dedup.ROWS) ** b >= substring_dedup.RECALL > 1 - (1 - 0.8**substring_dedup.ROWS) ** (b - 1)


def test_passages_inside_and_between_lines(docs_of):
    rng = random.Random(2)
    passage = " ".join(prose(rng, 9) + "." for _ in range(7))
    edited = passage.split()
    edited[10] = "changed"
    rows = [(i, "\n".join(prose(rng, 40) for _ in range(3))) for i in range(20)]
    rows[3] = (3, rows[3][1] + "\n" + passage)
    rows[8] = (8, prose(rng, 30) + " " + passage + " " + prose(rng, 30))  # inside a line
    rows[9] = (9, prose(rng, 30) + "\n" + " ".join(edited))  # a near copy of the paragraph
    rows[12] = (12, passage)
    rows += [(30, None), (31, ""), (None, passage), (32, "short line\nshort line"), (33, "short line")]
    spans = substring_dedup.repeated_spans(docs_of(rows)).collect()
    assert {r.doc_id for r in spans} == {8, 9, 12} and {r.kept_doc_id for r in spans} == {3}
    texts = dict(rows)
    for r in spans:
        assert len(texts[r.doc_id][r.start:r.stop].split()) >= 25
    cut = substring_dedup.without_repeats(docs_of(rows))
    assert cut.columns == docs_of(rows).columns
    left = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert left.keys() == {i for i, _ in rows if i not in (12, None)}  # 12 has nothing left
    assert left[9] == rows[9][1].split("\n")[0] + "\n" and len(left[8].split()) <= 85
    assert all(left[i] == t for i, t in rows if i not in (8, 9, 12, None))
    assert substring_dedup.repeated_spans(docs_of([])).collect() == []


def test_paragraph_clusters_are_whole(docs_of):
    """Every paragraph that has a near copy in a document of a smaller id is found."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 60).replace(".", "")) for i in range(10)]
    for i in range(10, 60):
        w = rng.choice(rows[:10])[1].split()
        for _ in range(rng.randint(0, 1)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    want = brute.linked(rows, 5)
    spans = [r for r in substring_dedup.repeated_spans(docs_of(rows)).collect() if r.kind == "paragraph"]
    assert {r.doc_id: r.kept_doc_id for r in spans} == {i: c for i, c in want.items() if c != i}


def crowd(rng, texts=400, twins=40):
    """Texts of one template with other values in five places, under the limit to each other (0.778), and twins of some
    that share one of the values (0.818)."""
    def filled(values):
        return " ".join(values.get(at, f"t{at}") for at in range(204))

    new = lambda: f"v{rng.randrange(10**9)}"
    rows = [{at: new() for at in range(20, 200, 40)} for _ in range(texts)]
    rows += [{at: v if at == 20 else new() for at, v in w.items()} for w in rows[:twins]]
    return [(i, filled(w)) for i, w in enumerate(rows)]


def test_template_crowds_are_compared_whole(docs_of):
    rows = crowd(random.Random(8))
    want = brute.linked(rows, 5)
    assert len({c for c in want.values()}) == 400
    assert {r.doc_id: r.component_id for r in near_dedup.linked(docs_of(rows)).collect()} == want


def test_crowds_of_many_blocks(docs_of, monkeypatch):
    """Twins in different blocks of a region meet, as documents and as paragraphs."""
    monkeypatch.setattr(linking, "BLOCK", 60)
    rows = crowd(random.Random(9))
    want = brute.linked(rows, 5)
    assert {r.doc_id: r.component_id for r in near_dedup.linked(docs_of(rows)).collect()} == want
    spans = [r for r in substring_dedup.repeated_spans(docs_of(rows)).collect() if r.kind == "paragraph"]
    assert {r.doc_id: r.kept_doc_id for r in spans} == {i: c for i, c in want.items() if c != i}


def test_a_crowd_of_copies_gives_fewer_links_than_rows(spark):
    """600 sets that are linked with each other and share all places: links join components, no pair is returned twice."""
    rng = random.Random(10)
    words = sorted(rng.sample(range(10**9), 60))
    sets = [sorted(rng.sample(words, 59)) for _ in range(600)] + [sorted(rng.sample(range(10**9), 59)) for _ in range(5)]
    rows = [(i, 59, i, tree, b"ab", tree, b"ab" * 3, bytes(64), np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets) for tree in range(3)]
    table = spark.createDataFrame(rows, "node long, size long, component long, tree int, region binary, nth int, places binary, "
                                        "signature binary, shingles binary")
    links = [(r.a, r.b) for r in linking.compared(table, 80, 0.1, 2, True).collect()]
    assert len(links) == 599 and max(b for _, b in links) < 600
    assert set(brute.components(links).values()) == {0}
    some = linking.compared(table.drop("shingles"), 80, 0.1, 2, False).collect()
    assert sorted((r.node, r.tree) for r in some) == [(i, 0) for i in range(605)]  # compared in the first place only


def test_clean_documents_stay(spark):
    docs = table(spark, SF, "documents")
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    spans = {r.doc_id for r in substring_dedup.repeated_spans(docs).collect()}
    for r in docs.collect():
        if r.doc_id not in spans:
            assert cut[r.doc_id] == r.text
