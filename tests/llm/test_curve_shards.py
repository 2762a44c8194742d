import itertools
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import curve_shards as c


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_point_by_single_steps(spark, n, bits):
    dims = [f"d{k}" for k in range(n)]
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame([(*p, 7) for p in points], ", ".join(f"{d} int" for d in dims) + ", axis_0 int")
    found = c.with_curve(df, dims, bits, "at")
    assert found.columns == [*dims, "axis_0", "at"]
    order = [tuple(r[d] for d in dims) for r in sorted(found.collect(), key=lambda r: r["at"])]
    assert sorted(r["at"] for r in found.collect()) == list(range(len(points)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def test_steps_are_shares_of_rows(spark):
    values = [None] * 3 + ["a"] * 5 + ["b"] * 2 + ["c"] * 90
    df = spark.createDataFrame([(v,) for v in values], "`x y` string").repartition(5)
    bounds = c.step_bounds(df, "x y", 4)
    # Rows before a value, times 16 steps, over 100 rows: null and 'a' share a step.
    assert bounds == [(0, None), (1, "b")]
    found = df.select("x y", c.step_of(F.col("`x y`"), bounds).alias("step")).distinct().collect()
    assert {(r[0], r[1]) for r in found} == {(None, 0), ("a", 0), ("b", 1), ("c", 1)}
    many = spark.range(1000).selectExpr("id % 500 AS v")
    assert len(c.step_bounds(many, "v", 3)) == 8
    assert c.step_bounds(many.filter("v < 0"), "v", 3) == []


def placed(df, shards, dims=c.DIMENSIONS):
    return c.place_rows(c.metadata(df, dims, "doc_id", "text", F.monotonically_increasing_id()), shards)


@pytest.mark.parametrize("shards", [7, 500])
def test_counts_differ_by_one_at_most(edge, shards):
    df, rows, empty = edge
    found = placed(df, shards).collect()
    assert Counter(r.id for r in found) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in found)
    assert placed(empty, shards).collect() == []


def test_result_does_not_depend_on_partitioning(spark, edge):
    df, _, _ = edge
    twice = df.union(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("bigint")))
    a, b = ({tuple(r)[1:] for r in placed(x, 9).collect()} for x in (twice.repartition(3), twice.repartition(11)))
    assert a == b and len(a) == twice.count()


def test_files_hold_all_rows_and_skip_more_than_in_order_of_id(spark, tmp_path):
    rows = [(i, f"text {i}", f"l{i * 7 % 8}", f"s{i * 13 % 16}", i * 31 % 1000, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, part string")
    report = c.write_shards(df, str(tmp_path / "shards"), 40, bits=4).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.drop("part_").select(*df.columns).collect()) == sorted(df.collect())
    assert back.select("part_").distinct().count() == 40
    assert sum(r.n_rows for r in report) == 4000 and {r.n_rows for r in report} == {100}
    assert sum(r.bytes for r in report) == sum(len(t.encode()) + 16 for _, t, *_ in rows)
    # Shards that a filter on any one dimension has to read; in order of id it is all 40 of them.
    for name, low, high in [("lang", "l3", "l3"), ("source", "s11", "s11"), ("n_chars", 400, 450)]:
        read = [r for r in report if r[f"least_{name}"] <= high and r[f"greatest_{name}"] >= low]
        assert len(read) <= 24
