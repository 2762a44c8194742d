from collections import defaultdict

import pytest

from tests.llm import brute
from tidemark.llm import mixing as m


def test_targets_are_water_filled(spark):
    cases = [{"a": 10, "b": 1000, "c": 500, "d": 3, None: 7}, {"a": 0, "b": 0}, {"x": 5}, {f"s{k:02}": (k * 37) % 101 for k in range(23)}]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r.source: r.target for r in m.targets(df).collect()}
        assert found == pytest.approx(brute.water_fill(sizes))


def test_taken_words_meet_targets(spark):
    rows = [(k, "w " * (1 + k * 7919 % 50), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = m.mix(df.repartition(3)).collect()
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for r in found:
        assert r.size == 1 + r.doc_id * 7919 % 50
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = r.target
    assert targets == pytest.approx(brute.water_fill(sizes))
    assert all(abs(taken[s] - targets[s]) <= 25 for s in sizes)  # half of the longest document
    again = {r.doc_id: r.taken for r in m.mix(df.repartition(11)).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_stage_repeats_rows(spark, edge):
    df, rows, empty = edge
    wanted = {r.doc_id: r.taken // r.size for r in m.mix(df).collect() if r.taken}
    mixed = m.stage(spark, df, "")
    assert mixed.columns == df.columns
    counts = {r.doc_id: r["count"] for r in mixed.filter(mixed.text.rlike("[A-Za-z]")).groupBy("doc_id").count().collect()}
    assert counts == wanted
    assert m.mix(empty).count() == 0
    assert m.stage(spark, empty, "").count() == 0
    assert m.mix(df.union(df)).count() == 2 * len(rows)


def test_empty_texts_behind_the_cut_take_nothing(spark):
    """Steps of 10, 20,000 and 0 words in one hash range with 6 wanted: 10 are taken."""
    rows = [("x", 10, 1), ("x", 20_000, 2), ("x", 0, 3), ("y", 20_010, 1)]
    sizes = spark.createDataFrame(rows, "source string, size bigint, u bigint")
    found = {r.mix_source: r for r in m.plan(sizes, weights=(6, 40_014)).collect()}
    assert (found["x"].target, found["x"].epochs, found["x"].last) == (6, 0, 1)


def test_mix_agrees_with_the_sql_where_texts_are_empty(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = [(None, "", " \n", "w " * 3, "w " * 400)[k % 5] for k in range(3000)]
    rows = [(k, t, "abc"[k % 7 % 3]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    documents = df.toArrow()  # noqa: F841
    with duckdb.connect() as con:
        con.register("documents", documents)
        wanted = {r[0]: r[4] for r in con.sql(m.SQL).fetchall()}
    assert {r.doc_id: r.taken for r in m.mix(df).collect()} == wanted
