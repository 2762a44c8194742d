"""Exact interpolated quantiles from ranked distinct values.

The built-in exact percentile keeps every distinct value of a group in one task. Here the distinct
values stay distributed: the rows whose rank range covers a wanted position are picked out, two per
quantile, and interpolated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import point_block, ranked_values
from tidemark.session import small_table

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def positions(size: int, p: float) -> tuple[int, int, float]:
    """The two neighbouring positions of a quantile and the weight of the upper one."""
    place = p * (size - 1)
    low = math.floor(place)
    return low, min(low + 1, size - 1), place - low


def interpolated(values: dict[int, float], size: int, p: float) -> float | None:
    if not size:
        return None
    low, high, weight = positions(size, p)
    return values[low] + (values[high] - values[low]) * weight


def pick_quantiles(
    ranked: DataFrame,
    value: str,
    probabilities: dict[str, float],
    sizes: dict[str | None, int],
    by: str | None = None,
    n: str = "n",
    before: str = "before",
) -> dict[str | None, dict[str, float | None]]:
    """Quantiles per group for groups whose sizes are known, hence few.

    Only the rows at the wanted positions leave the executors: at most two per group and quantile.
    """
    wanted = sorted(
        {
            (g, spot)
            for g, size in sizes.items()
            if size
            for p in probabilities.values()
            for spot in positions(size, p)[:2]
        },
        key=repr,
    )
    found: dict[str | None, dict[int, float]] = {g: {} for g in sizes}
    if wanted:
        first, after = F.col(before), F.col(before) + F.col(n)
        v = F.col(value).cast("double").alias("_v")
        if by is None:
            covers = F.lit(False)
            for _, spot in wanted:
                covers = covers | ((first <= spot) & (after > spot))
            rows = ranked.filter(covers).select(v, first.alias("_a"), after.alias("_z")).collect()
            for _, spot in wanted:
                found[None][spot] = next(r["_v"] for r in rows if r["_a"] <= spot < r["_z"])
        else:
            kind = ranked.schema[by].dataType.simpleString()
            spots = small_table(ranked.sparkSession, wanted, f"_g {kind}, _spot bigint")
            inside = (F.col(by) == F.col("_g")) & (first <= F.col("_spot")) & (after > F.col("_spot"))
            for r in ranked.join(F.broadcast(spots), inside).select("_g", "_spot", v).collect():
                found[r["_g"]][r["_spot"]] = r["_v"]
    return {
        g: {name: interpolated(found[g], size, p) for name, p in probabilities.items()}
        for g, size in sizes.items()
    }


def overall_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float]
) -> dict[str, float | None]:
    """Quantiles of a whole column as plain numbers."""
    ranked = ranked_values(df, value)
    size = ranked.agg(F.sum("n")).first()[0] or 0
    return pick_quantiles(ranked, value, probabilities, {None: size})[None]


def block_quantiles(
    counts: DataFrame,
    value: str,
    probabilities: dict[str, float],
    cuts: Sequence[float],
    per_block: dict[int, int],
) -> dict[str, float | None]:
    """Quantiles of a column whose rows are counted (``n``, equal values may repeat) when the rows in each
    block of ``cuts`` are known: only the one or two blocks that hold a wanted position are ranked."""
    size = sum(per_block.values())
    spots = sorted({spot for p in probabilities.values() for spot in positions(size, p)[:2]}) if size else []
    starts, reached = {}, 0
    for b in sorted(per_block):
        if any(reached <= spot < reached + per_block[b] for spot in spots):
            starts[b] = reached
        reached += per_block[b]
    found = {}
    if spots:
        v = F.col(value).cast("double")
        inside = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(*[F.when(F.col("_b") == b, F.lit(s).cast("bigint")) for b, s in starts.items()])
        rows = (
            counts.filter(F.col(value).isNotNull())
            .select(point_block(cuts, v).alias("_b"), v.alias("_v"), "n")
            .filter(F.col("_b").isin(*starts))
            .groupBy("_b", "_v")
            .agg(F.sum("n").alias("n"))
            .withColumn("_a", start + F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .withColumn("_z", F.col("_a") + F.col("n"))
        )
        covers = F.exists(F.array(*[F.lit(s).cast("bigint") for s in spots]), lambda s: (F.col("_a") <= s) & (s < F.col("_z")))
        picked = rows.filter(covers).select("_v", "_a", "_z").collect()
        found = {spot: next(r["_v"] for r in picked if r["_a"] <= spot < r["_z"]) for spot in spots}
    return {name: interpolated(found, size, p) for name, p in probabilities.items()}


def _at(position: Column, value: Column, before: Column, n: Column) -> Column:
    return F.max(F.when((before <= position) & (position < before + n), value))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """One row of quantiles per group.

    ``few_groups`` states that the groups of a single ``by`` column are bounded by the call itself
    (named columns, a flag). Any number of groups is handled without that statement, by a join of
    each group's size that Spark plans from the sizes it sees.
    """
    by, spark = list(by), df.sparkSession
    columns = ", ".join(f"{q} double" for q in probabilities)
    if not by:
        marks = overall_quantiles(df, value, probabilities)
        return small_table(spark, [tuple(marks.values())], columns)
    ranked = ranked_values(df, value, by)
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("_size"))
    if few_groups and len(by) == 1:
        known = {r[0]: r[1] for r in sizes.collect()}
        marks = pick_quantiles(ranked, value, probabilities, known, by[0])
        kind = ranked.schema[by[0]].dataType.simpleString()
        rows = [(g, *m.values()) for g, m in marks.items()]
        return small_table(spark, rows, f"{by[0]} {kind}, {columns}")
    sized = ranked.join(sizes, by)
    v, b, c = F.col(value).cast("double"), F.col("before"), F.col("n")
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_size") - 1)
        low = F.floor(position)
        picks += [
            _at(low, v, b, c).alias(f"_lo_{name}"),
            _at(F.least(low + 1, F.col("_size") - 1), v, b, c).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_f_{name}"),
        ]
    picked = sized.groupBy(*by).agg(*picks)
    return picked.select(
        *by,
        *[
            (F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_f_{q}")).alias(q)
            for q in probabilities
        ],
    )
