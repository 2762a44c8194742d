import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import personal_data as p
from tidemark.llm.common import text_of

CASES = [
    "", "a@b.c@d.e", "x@y", "x@@y.z", ".a-b+c@d-e.f.g.", "@b.c a@.c", "a@b.c.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 10.0.0.1",
    "0001.002.3.255", "1.2.3", "9" * 5000, "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111 1111 1111 1112",
    "4111  1111 1111 1111", "+1 (555) 010-0000 or +44 20 7946 0958.", "+1 2", "+12345678", "+1 (((((", "++1 555 555 55 55",
    "é漢 me@köln.de", "a@b.c, b@c.d;c@d.e", "1" * 20 + ".1.1.1", "+" + "1 " * 40, "a" * 3000 + "@x", "0000000000000000",
]


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(k, t) for k, t in enumerate(CASES)]
    return p.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_patterns_match_brute_force():
    for text in CASES:
        assert p.written(p.base_spans(text)) == ",".join(brute.personal_spans(text)), text


def test_trees_fit_a_rule_and_serve_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = p.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.decide(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_new_examples_are_told_apart(trained):
    right = wrong = positive = negative = 0
    for text, kind, label in p.seeded_examples(100, seed=1234):
        found = any(c[0] == kind for c in trained.spans(text)[1])
        positive, negative = positive + label, negative + 1 - label
        right, wrong = right + (found and label), wrong + (found and not label)
    assert right > 0.95 * positive and wrong < 0.02 * negative


def test_spans_do_not_overlap_and_base_spans_stay(trained):
    text = "mail joe (at) example (dot) com or a@b.org, call (555) 010-4477, ip 10.0.0.1, card 4111 1111 1111 1111"
    base, spans = trained.spans(text)
    assert set(base) <= set(spans) and len(spans) > len(base)
    places = sorted((a, b) for _, a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))


def test_documents(spark, edge, trained):
    df, rows, empty = edge
    found = df.select("doc_id", p.scanned(text_of("text"), trained).alias("s")).collect()
    assert {x.doc_id: x.s.base for x in found} == {i: ",".join(brute.personal_spans(t or "")) for i, t in rows}
    assert all(x.s.spans == x.s.base for x in found)  # the prose has nothing to add
    assert empty.select(p.scanned(text_of("text"), p.fit(empty))).count() == 0


@pytest.mark.parametrize("text", ["write to joe @ example.com now", "joe@example (dot) com", "joe@example dot com"])
def test_an_at_sign_is_a_hint(text):
    assert p.base_spans(text) == []
    assert [c[0] for c in p.candidates(text)] == [0]


def test_corpus_candidates_are_labelled_by_patterns_and_formats_alone():
    import pyarrow as pa

    def labels(text):
        (found,) = p._corpus_rows(iter([pa.record_batch([pa.array([text])], names=["text"])]))
        return found.column(1).to_pylist()

    for text in ("joe (at) example (dot) com", "call (555) 010-4477", "card 3782 822463 10005", "10[.]0[.]0[.]1"):
        assert p.candidates(text) and 0 not in labels(text)[:1], text
    assert set(labels("on 2024-01-05")) == {0} and set(labels("v 1.2.3.1400")) == {0}
    assert labels("a@b.org") == [1]
