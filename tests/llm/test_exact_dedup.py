from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import exact_dedup as x


def test_groups(edge):
    df, rows, empty = edge
    wanted = brute.exact_groups(rows)
    found = x.mark(df).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    texts = dict(rows)
    assert all(r.text_sha256 == brute.sha("".join((texts[r.doc_id] or "").split())) for r in found)
    assert x.mark(empty).count() == 0


def test_stage_keeps_one_row_of_each(spark, edge):
    df, rows, empty = edge
    wanted = sorted({keep for keep, _ in brute.exact_groups(rows).values()})
    once = x.stage(spark, df, "")
    assert once.columns == df.columns
    assert sorted(r.doc_id for r in once.collect()) == wanted
    # Rows that repeat id and text come out once as well.
    assert sorted(r.doc_id for r in x.stage(spark, df.union(df), "").collect()) == wanted
    assert x.stage(spark, empty, "").count() == 0


def test_null_ids_come_last(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "ab"), (3, "a b"), (None, "solo")], "doc_id bigint, text string")
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in x.mark(df).collect()}
    assert found == {(None, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (None, None, 1, True)}


def test_filter_lets_unique_rows_pass(spark):
    rows = [(k, f"text number {k}") for k in range(3000)] + [(k, "the same") for k in range(3000, 4500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = x.Groups(df, "doc_id", "text")
    assert found.filter.rows == 4500
    maybe = {r.id for r in found.maybe.select("id").collect()}
    assert set(range(3000, 4500)) <= maybe
    assert len(maybe) < 1500 + 3000 * 0.1
    marked = x.mark(df)
    assert marked.filter("kept").count() == 3001
    assert marked.filter("keep_id = 3000").count() == 1500


def test_stage_with_names_of_its_own(spark, edge):
    df, rows, _ = edge
    names = ["bucket_0", "bucket_0_of", "bucket_1_of", "bits_1", "group_sha", "sha", "row_sha"]
    wide = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    found = x.stage(spark, wide, "")
    assert found.columns == wide.columns
    found = found.collect()
    assert sorted(r.doc_id for r in found) == sorted({keep for keep, _ in brute.exact_groups(rows).values()})
    assert all(r[c] == k for r in found for k, c in enumerate(names))
