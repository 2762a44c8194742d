import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import secret_scan as s

CASES = [
    "", None, 'password = "hunter22"', "PassWord:abc", "API_KEY='x.y/z-9=='", "token token=abcdef token: 123456",
    "secret \n = value1", "AKIA" + "A1B2" * 4, "AKIA" + "A1" * 7, "deadbeef" * 3, "deadbee" * 3, "ab" * 500,
    'token = "0123456789abcdef0123456789abcdef"', "é漢 passwd=geheim1 é", "ſecret=abcdefgh", "api_key:  'qwertz99",
]


def models(spark, rows):
    prose = "the quick brown fox jumps over a lazy dog and internationalisation of government_departments follows "
    text = [(k, t) for k, t in enumerate(CASES)] + [(100 + k, prose * 3 + str(k)) for k in range(20)]
    return s.fit(spark.createDataFrame(text + rows, "doc_id bigint, text string"))


@pytest.fixture(scope="module")
def trained(spark):
    return models(spark, [])


def test_patterns_match_brute_force(trained):
    for text in CASES:
        found = s.written(trained.spans(text or "")[0])
        assert found == ",".join(brute.secret_spans(text or ""))


def test_models_find_random_strings_and_leave_words_alone(trained):
    rng = np.random.default_rng(77)
    for name, alphabet in s.KEY_ALPHABETS.items():
        tokens = s.random_strings(alphabet, rng, 200)
        hit = [any(k == 3 or k == 2 for _, k, _ in trained.spans(f"see {t} there")[1]) for t in tokens]
        assert np.mean(hit) > 0.97, name
    for word in ["internationalisation_of_governments", "A" * 40, "=" * 60, "the-lazy-brown-fox-jumps-over"]:
        assert trained.spans(f"see {word} there")[1] == []


def test_added_spans_touch_no_base_span(trained):
    value = s.random_strings(s.KEY_ALPHABETS["mixed"], np.random.default_rng(5), 1)[0]
    base, spans = trained.spans(f"token = {value} and {value}")
    assert [k for _, k, _ in base] == [0] and [k for _, k, _ in spans] == [0, 3]


def test_documents(spark, edge, trained):
    df, rows, empty = edge
    from tidemark.llm.common import text_of

    found = df.select("doc_id", s.scanned(text_of("text"), trained).alias("s")).collect()
    assert {x.doc_id: x.s.base for x in found} == {i: ",".join(brute.secret_spans(t or "")) for i, t in rows}
    assert s.fit(empty).ordinary is None
    assert empty.select(s.scanned(text_of("text"), s.fit(empty))).count() == 0


def test_threshold_does_not_depend_on_partitions(spark):
    """More than 200 held-out tokens of growing oddity: all count, however the rows are dealt."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnoprst"), 6)) for _ in range(400)]
    rows = [(k, " ".join("_".join(rng.choice(words, 4)) for _ in range(30)) + f" n{k}") for k in range(60)]
    rows.append((99, " ".join("-".join("qzxjkvw"[(k + j) % 7] + "aeiou"[j % 5] + str(k * j % 10) for j in range(9)) for k in range(40))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokens = {t for b in [s._sample_counts(iter([s.pa.record_batch([s.pa.array([r[1] for r in rows])], names=["text"])]))]
              for x in b for t in x.column(3).to_pylist() if t}
    assert len(tokens) > 200
    found = [s.fit(df.orderBy("doc_id").repartition(1)), s.fit(df.repartition(7)), s.fit(df.orderBy(s.F.desc("doc_id")).coalesce(2))]
    assert len({m.threshold for m in found}) == 1
    assert found[0].threshold == max([s.MARGIN, *(r + 0.2 for r in map(found[0].ratio, tokens) if r < s.MARGIN + 0.4)])
