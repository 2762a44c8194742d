"""Mixing sources to target weights by capped water-filling, in DataFrame and SQL functions alone.

Sources ask for shares of all words by their weights. A source stops at ``max_epochs`` times its size;
what it leaves goes to the others by weight until none is above its cap. Sorted by cap over weight,
the sources that stop come first, so the final level is one pass of running sums over the sources
(a row each, whatever the number of documents).

Every document of a source is taken the whole number of times; for the fraction, documents are taken
in the order of a seeded hash until the target is met as nearly as whole documents allow. The cut is
found from sums over hash ranges, then inside the one range that holds it, so that no source, however
large, is sorted as a whole. Reruns agree, as the hash is of the id and a seed.

Defined cases: a null text has size 0, a null source is a source that comes last; sources of size 0
get target 0; repeated ids share a hash and are taken alike; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, columns, documents, fresh, quoted, text_of
from tidemark.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
RANGE_BITS = 12
HASH_BITS = 60


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def hash_of(id_: Column, seed: int = SEED) -> Column:
    """The first 60 bits of the MD5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` for each row of (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    s = s.withColumn("level", F.when(F.col("level") <= ratio, F.col("level")))
    level = F.first("level", ignorenulls=True).over(everything)
    s = s.withColumn("level", level)
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def plan(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each source of ``sizes`` (source, size, u): source_size, target, whole repetitions and
    the last hash that gets one repetition more (-1 if none does)."""
    ranges = sizes.groupBy("source", F.shiftright("u", HASH_BITS - RANGE_BITS).alias("range")).agg(
        F.sum("size").alias("words")
    )
    ranges = materialize(ranges, "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sources, weights, max_epochs)
    epochs = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("int"))
    goal = goal.withColumn("wanted", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal.withColumnRenamed("source", "mix_source"), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("mix_source"))

    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    cut = before.join(goal, same).filter("before < wanted AND wanted <= before + words")
    cut = materialize(cut.select("mix_source", "range", "before", "wanted"), "mix-cuts")
    inside = sizes.join(cut, same & (F.shiftright("u", HASH_BITS - RANGE_BITS) == F.col("range")))
    steps = inside.groupBy("mix_source", "u", "before", "wanted").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("mix_source").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    taken = steps.filter("words > 0 AND before + words / 2.0D <= wanted").groupBy("mix_source").agg(F.max("u").alias("last"))
    # Where not even the first document of the range is taken, the cut is the end of the range before.
    cuts = cut.join(taken.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")), "left")
    at = F.coalesce("last", F.shiftleft(F.col("range"), HASH_BITS - RANGE_BITS) - 1)
    cuts = cuts.select(F.col("mix_source").alias("s"), at.alias("last"))
    whole = goal.join(cuts, F.col("mix_source").eqNullSafe(F.col("s")), "left")
    last = F.coalesce("last", F.lit(-1))
    return materialize(whole.select("mix_source", "source_size", "target", "epochs", last.alias("last")), "mix-plan")


def _sizes(df: DataFrame, id_: str, text: str, source: str) -> DataFrame:
    return df.select(
        quoted(id_).alias("id"),
        quoted(source).alias("source"),
        size_of(text_of(text)).alias("size"),
        hash_of(quoted(id_)).alias("u"),
    )


def repetitions() -> Column:
    return F.col("epochs") + (F.col("u") <= F.col("last")).cast("int")


def mix(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, taken."""
    sizes = materialize(_sizes(df, id_, text, source), "mix-sizes")
    joined = sizes.join(plan(sizes), F.col("source").eqNullSafe(F.col("mix_source")))
    taken = (F.col("size") * repetitions()).cast("bigint")
    return joined.select(F.col("id").alias(id_), "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    sizes = materialize(_sizes(df, id_, text, source), "mix-sizes")
    names = ["mix_source", "epochs", "last"]
    named = dict(zip(names, fresh(df, *names)))
    u, copy = fresh(df, "mix_u", "mix_copy")
    rows = df.withColumn(u, hash_of(quoted(id_)))
    wanted = plan(sizes).select(*(F.col(a).alias(b) for a, b in named.items()))
    rows = rows.join(wanted, quoted(source).eqNullSafe(quoted(named["mix_source"])))
    n = quoted(named["epochs"]) + (quoted(u) <= quoted(named["last"])).cast("int")
    rows = rows.withColumn(copy, n).filter(quoted(copy) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), quoted(copy)))).select(*columns(df.columns))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def op6_mixing(spark, folder: str) -> DataFrame:
    return mix(documents(spark, folder))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS u FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST) AS k FROM s),
l AS (
  SELECT level FROM o WHERE level <= 3 * source_size / w::DOUBLE ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM l) * w) AS target FROM s),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM t),
g AS (
  SELECT source, u, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, u),
c AS (
  SELECT g.*, e.target - e.epochs * e.source_size AS wanted,
         coalesce(sum(size) OVER (PARTITION BY g.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source),
m AS (
  SELECT source, max(u) AS last FROM c WHERE size > 0 AND before + size / 2.0::DOUBLE <= wanted GROUP BY source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN u <= coalesce(m.last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source"""
