import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm import brute
from tidemark.llm import simhash as s


def signed(values):
    return [int(v) for v in np.array(values, np.uint64).view(np.int64)]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in signed(values)], "fp bigint").repartition(4)


def near_clusters(seed, clusters, size, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))))
    return sorted(out | {rng.getrandbits(64) for _ in range(200)})


def found_classes(spark, values, **options):
    pairs = s.links(frame(spark, values), **options)
    roots = {r.node: r.root for r in s.components(pairs).collect()}
    return {v: roots.get(v, v) for v in signed(values)}


def same_partition(a, b):
    first = {}
    return all(first.setdefault(("a", a[k]), b[k]) == b[k] and first.setdefault(("b", b[k]), a[k]) == a[k] for k in a)


def test_fingerprint():
    for text in ["", "one", "a b", "A b C d e f", "x " * 300, "é Ä b c d\x0be\x0cf"]:
        assert s.fingerprint(text.encode()) == brute.fingerprint(text)


@pytest.mark.parametrize("large_value", [2048, 8])
def test_links_lose_nothing(spark, large_value):
    values = near_clusters(5, 12, 60, 3)
    wanted = dict(zip(signed(values), (brute.classes(values)[v] for v in values)))
    assert same_partition(found_classes(spark, values, large_value=large_value), wanted)


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 500, np.uint64)
    bits = s._bits(values)
    both = bits.T.astype(float) @ bits
    for m in (2, 3, 4, 5):
        probing = s.Probing(10**6, both, m=m)
        assert sorted(b for g in probing.groups for b in g) == list(range(64))
        limits = probing.thresholds(bits)
        assert (limits.sum(axis=1) == s.LIMIT - m + 1).all() and limits.min() >= -1
    assert s.partition_count(10**9) <= s.partition_count(10**4)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5001)] * 3
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    roots = {r.node: r.root for r in s.components(df).collect()}
    assert {roots[k] for k in range(301)} == {0}
    assert {roots[k] for k in range(1000, 1400)} == {1000}
    assert roots[5001] == 5000 and len(roots) == 301 + 400 + 2
    assert s.components(df.limit(0)).count() == 0


def test_documents(spark, edge):
    df, rows, empty = edge
    found = s.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.components(rows)
    assert {r.doc_id: r.fp for r in found} == {i: signed([brute.fingerprint(t)])[0] for i, t in rows}
    assert s.near_duplicates(empty).count() == 0
    once = s.stage(spark, df, "")
    assert once.columns == df.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(brute.components(rows).values()))


def test_null_and_repeated_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (4, text), (4, text), (9, "other words here now then"), (None, "alone among all the words")]
    found = s.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id or -1) for r in found) == [
        ("4", 4), ("4", 4), ("9", 9), ("None", -1), ("None", 4),
    ]


def test_one_row_of_each_component_stays(spark):
    a, b, c = "one two three four five six", "other words here now then and again", "alone among all the words of it"
    rows = [(3, a), (5, a + " "), (5, b), (7, b), (7, b), (None, b), (None, c), (None, c)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = s.one_of_each(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == [("3", a), ("5", b), ("None", c)]


def test_stage_of_written_rows(spark, edge, tmp_path, monkeypatch):
    """Rows named by file and position: those that stay with numbers, by maps and by shuffle, clashing
    names and repeated rows included."""
    df, rows, empty = edge
    names = ["gone", "place", "number", "map_bits", "_metadata"]
    wide = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    wide.union(wide.filter("doc_id % 3 = 0")).repartition(4).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert s.scanned_rows(read) is not None and s.scanned_rows(wide.union(wide)) is None
    wanted = sorted(set(brute.components(rows).values()))
    for most in (s.MAPS_AT_ONCE, 0):
        monkeypatch.setattr(s, "MAPS_AT_ONCE", most)
        once = s.stage(spark, read, "")
        assert once.columns == read.columns
        assert sorted(r.doc_id for r in once.collect()) == wanted
    assert sorted(r.doc_id for r in s.one_of_each(wide).collect()) == wanted
    empty.write.parquet(str(tmp_path / "empty"))
    assert s.stage(spark, spark.read.parquet(str(tmp_path / "empty")), "").count() == 0
