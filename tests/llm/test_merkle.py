import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import merkle as m

FIELDS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lowered():
    return {"text": F.when(F.col("doc_id") % 2 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}


def values(r):
    return (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)


def check(df, rows):
    wanted = brute.merkle(rows, FIELDS, lambda d: d["doc_id"] is not None and d["doc_id"] % 2 == 0)
    found = m.verify(df, lowered()).collect()
    assert sorted(values(r) for r in found) == sorted(wanted.values())
    assert all(values(r) == wanted[r.doc_id] for r in found if r.doc_id is not None)
    return found


def test_edge_table(edge):
    df, _, empty = edge
    rows = [tuple(r)[:5] for r in df.collect()]
    found = check(df, rows)
    assert any(r.verified for r in found) and not all(r.verified for r in found)
    assert m.verify(empty, lowered()).collect() == []
    assert m.build(m.leaves(empty, "lang", "doc_id", m.FIELDS)).root is None


@pytest.mark.parametrize("n", [1, 9])
def test_one_partition(spark, n):
    rows = [(i, f"Text {i}", "en", None, 3) for i in range(n)]
    found = check(spark.createDataFrame(rows, SCHEMA), rows)
    assert {r.subroot for r in found} == {r.root for r in found}


def test_partitions_of_one_row_and_null_ids(spark):
    rows = [(None, f"T{i}", lang, "s", 1) for i, lang in enumerate([None, "a'b", "ab", "=", "-", "é", "a/0", "^"])]
    rows += [(5, "A", "xx", "s", None), (5, "B", "xx", "s", None), (5, "A", "xx", "s", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = brute.merkle(rows, FIELDS, lambda d: False)
    found = m.verify(df, {}).collect()
    assert {r.root for r in found} == {next(iter(wanted.values()))[2]} and all(r.verified for r in found)
    assert len(found) == len(rows)


def test_climbs_by_both_joins_and_any_partitioning(spark):
    rows = [(i, f"Row {i % 700}", "hot" if i % 3 else f"l{i % 11}", "s", i % 5) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = m.build(m.leaves(df, "lang", "doc_id", m.FIELDS))
    assert manifest.leaves == 9000
    # Nodes of a run of leaves weigh less than a thousandth and go by shuffle, the others by broadcast.
    assert manifest.links.filter("leaves * 1000 < 9000").count() > 1000
    assert 0 < manifest.links.filter("leaves * 1000 >= 9000").count() < 1000
    found = check(df.repartition(13), rows)
    assert sum(not r.verified for r in found) == 4500


def test_a_change_shows_only_at_its_row(spark):
    rows = [(i, "same", "en" if i % 2 else "de", "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    given = {"n_chars": F.when(F.col("doc_id") == 17, 99).otherwise(F.col("n_chars"))}
    assert [r.doc_id for r in m.verify(df, given).filter("NOT verified").collect()] == [17]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
