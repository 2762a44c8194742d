"""Shards along a Hilbert curve through metadata, in DataFrame and SQL functions alone.

Each metadata column is a dimension. Its values are quantised by depth: the rows of smaller values, as a
share of all rows, say in which of ``2^BITS`` steps a value lies. The steps of a row are a point of a grid,
the Hilbert curve through the grid gives the point one number, and rows are sorted by it. Neighbours on the
curve are neighbours in every dimension, so shards cut as runs of this order, and files and row groups
inside them, have narrow ranges in all dimensions, and a filter on any of them skips most files.

The law is ``rows``: shard ``k`` of ``s`` takes the rows from ``ceil(k n / s)`` on, so counts differ by
one at most. (``bytes`` is not aimed at: one long text may outweigh a shard of a small table.)

What holds at size: distinct values are counted before they shuffle and are ranked by running totals over
range-sorted blocks; of a dimension only the first value of each step, 64 at most, becomes part of the plan.
Rows are ranged by curve, checksum, id and at last a written row number, so that neither a source with a
third of all rows nor a thousand equal rows make a large task; the one broadcast has a row per block. The
text is read once, for its size and checksum; all sorting is of narrow rows.

Defined cases: a null in a dimension sorts before all values and takes part as a value; a null text has no
bytes, a size of 16 and the checksum of an empty text; rows at one point of the grid lie in order of
checksum and id, so copies lie together, null ids first; rows equal in all of these are interchangeable; with
fewer rows than shards some shards are empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import columns, documents, fresh, quoted
from tidemark.operators.ordering import BLOCK, SLOT, layout
from tidemark.session import materialize

BITS = 6
DIMENSIONS = ("lang", "source", "n_chars")
OVERHEAD = 16
SHARDS = 40


def _with_starts(laid: DataFrame, count: Column) -> DataFrame:
    """Add ``start``, the sum of ``count`` over all earlier blocks, and ``total``. A block is a partition of
    the range sort, so the table of blocks is small: it is summed up in one task and broadcast."""
    blocks = laid.groupBy(BLOCK).agg(count.alias("held"))
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        BLOCK,
        F.coalesce(F.sum("held").over(earlier), F.lit(0)).cast("bigint").alias("start"),
        F.sum("held").over(Window.partitionBy()).cast("bigint").alias("total"),
    )
    return laid.join(F.broadcast(starts), BLOCK)


def step_bounds(rows: DataFrame, column: str, bits: int = BITS) -> list:
    """The first value of each step in use, in order with null first: ``2^bits`` values at most."""
    value = quoted(column)
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    placed = _with_starts(layout(counts, [F.col("value").asc_nulls_first()], "steps"), F.sum("n"))
    inside = Window.partitionBy(BLOCK).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    steps = placed.withColumn("before", before).select("value", F.expr(f"before * {1 << bits} div total").alias("step"))
    first = steps.groupBy("step").agg(
        F.min("value").alias("value"), F.bool_or(F.col("value").isNull()).alias("null")
    )
    found = sorted(first.collect(), key=lambda r: r["step"])  # a row for each step, 2^bits at most
    return [(r["step"], None if r["null"] else r["value"]) for r in found]


def step_of(value: Column, bounds: Sequence[tuple]) -> Column:
    """The step of a value: that of the last bound not above it."""
    if len(bounds) < 2:
        return F.lit(bounds[0][0] if bounds else 0).cast("int")
    step = F
    for at, bound in reversed(bounds[1:]):
        step = step.when(value >= F.lit(bound), F.lit(at))
    return step.otherwise(F.lit(bounds[0][0])).cast("int")


def _bit(value: Column, at: int | Column) -> Column:
    return F.call_function("shiftright", value, at if isinstance(at, Column) else F.lit(at)).bitwiseAND(F.lit(1))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def with_curve(df: DataFrame, dims: Sequence[str], bits: int, name: str) -> DataFrame:
    """Add the place on the Hilbert curve of the point whose coordinates, ``bits`` wide, are in ``dims``.

    The coordinates are turned into the transposed index from the highest bit down: where a coordinate has
    the bit, the lower bits of the first are inverted, else they are exchanged with those of the first;
    then the bits are Gray-coded and read across the dimensions. The changes are a fold over an array, so
    that each is computed once; as nested expressions they would double with every step.
    """
    n = len(dims)
    turns = [F.struct(F.lit(bit).alias("bit"), F.lit(k).alias("axis")) for bit in range(bits - 1, 0, -1) for k in range(n)]

    def changed(point: Column, turn: Column) -> Column:
        x = F.element_at(point, turn["axis"] + 1)
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), turn["bit"]) - 1
        has = _bit(x, turn["bit"]) == 1
        differ = point[0].bitwiseXOR(x).bitwiseAND(low)
        first = point[0].bitwiseXOR(F.when(has, low).otherwise(differ))
        others = [F.when((turn["axis"] == k) & ~has, point[k].bitwiseXOR(differ)).otherwise(point[k]) for k in range(1, n)]
        return F.array(first, *others)

    def gray(point: Column) -> Column:
        axes = [point[0]]
        for k in range(1, n):
            axes.append(axes[-1].bitwiseXOR(point[k]))
        turned = F.lit(0).cast("bigint")
        for bit in range(bits - 1, 0, -1):
            turned = turned.bitwiseXOR(_bit(axes[-1], bit) * F.lit((1 << bit) - 1))
        return F.array(*axes, turned)

    def read(point: Column) -> Column:
        digits = [
            _bit(point[k].bitwiseXOR(point[n]), bit) * F.lit(1 << (bit * n + n - 1 - k))
            for bit in range(bits) for k in range(n)
        ]
        return sum(digits[1:], digits[0])

    point = F.array(*[quoted(d).cast("bigint") for d in dims])
    if turns:
        point = F.aggregate(F.array(*turns), point, changed)
    return df.withColumn(name, _let(_let(point, gray), read).cast("bigint"))


def metadata(df: DataFrame, dims: Sequence[str], id_: str, text: str, row: Column) -> DataFrame:
    """The narrow rows that are sorted: row, id, size, text_crc32 and the dimensions as ``dim_k``; written."""
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = df.select(
        row.alias("row"),
        quoted(id_).alias("id"),
        (F.octet_length(body).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[quoted(d).alias(f"dim_{k}") for k, d in enumerate(dims)],
    )
    return materialize(rows, "metadata")


def place_rows(rows: DataFrame, shards: int, bits: int = BITS) -> DataFrame:
    """``metadata`` rows with their place on the curve, their shard and their slot in it."""
    named = [c for c in rows.columns if c.startswith("dim_")]
    steps = ["step" + n.removeprefix("dim") for n in named]
    placed = rows.withColumns({s: step_of(F.col(n), step_bounds(rows, n, bits)) for s, n in zip(steps, named)})
    keys = [F.col("curve"), F.col("text_crc32"), F.col("id").asc_nulls_first(), F.col("row")]
    laid = layout(with_curve(placed, steps, bits, "curve").drop(*steps), keys, "curve")
    seated = _with_starts(laid, F.count("*")).withColumn("at", F.col("start") + F.col(SLOT))
    cut = seated.withColumn("shard", F.expr(f"at * {shards} div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return cut.select(*rows.columns, "curve", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))


def write_shards(
    df: DataFrame, folder: str, shards: int, dims: Sequence[str] = DIMENSIONS, id_: str = "doc_id", text: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """Write all columns of ``df`` below ``folder`` as Parquet, a folder ``part=k`` per shard with rows in order
    of their slots, and return per shard its rows, bytes and the least and greatest value of every dimension,
    by which a reader picks the shards that a filter needs.

    The rows are numbered in a written table first, so that a lost executor cannot number them anew; texts
    then move to their place by that number.
    """
    row, part, slot = fresh(df, "row", "part", "slot")
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = materialize(place_rows(metadata(numbered, dims, id_, text, quoted(row)), shards, bits), "placed")
    seats = placed.select(F.col("row").alias(row), F.col("shard").alias(part), F.col("slot").alias(slot))
    ordered = numbered.join(seats, row).repartitionByRange(part, slot).sortWithinPartitions(part, slot)
    ordered.select(*columns(df.columns), quoted(part)).write.partitionBy(part).parquet(folder)
    ranges = [f(f"dim_{k}").alias(f"{n}_{d}") for k, d in enumerate(dims) for n, f in (("least", F.min), ("greatest", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *ranges)


def op12_curve_shards(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    rows = metadata(docs, DIMENSIONS, "doc_id", "text", F.monotonically_increasing_id())
    return place_rows(rows, SHARDS).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _curve_sql() -> str:
    """The steps of ``with_curve`` as one common table expression each."""
    n, parts, at = len(DIMENSIONS), [], "g0"
    axes = [f"x{k}" for k in range(n)]

    def add(changed: dict[str, str]) -> None:
        nonlocal at
        parts.append(f"g{len(parts) + 1} AS (SELECT * REPLACE ({', '.join(f'{e} AS {a}' for a, e in changed.items())}) FROM {at})")
        at = f"g{len(parts)}"

    for bit in range(BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for x in axes:
            has = f"({x} >> {bit}) & 1 = 1"
            add(
                {"x0": f"CASE WHEN {has} THEN xor(x0, {low}) ELSE xor(x0, xor(x0, {x}) & {low}) END"}
                | ({} if x == "x0" else {x: f"CASE WHEN {has} THEN {x} ELSE xor({x}, xor(x0, {x}) & {low}) END"})
            )
    for before, x in zip(axes, axes[1:]):
        add({x: f"xor({x}, {before})"})
    turn = "0::bigint"
    for bit in range(BITS - 1, 0, -1):
        turn = f"xor({turn}, (({axes[-1]} >> {bit}) & 1) * {(1 << bit) - 1})"
    add({"turn": turn})
    digits = [f"((xor(x{k}, turn) >> {b}) & 1) * {1 << (b * n + n - 1 - k)}" for b in range(BITS) for k in range(n)]
    return ",\n".join(parts) + f",\nc AS (SELECT *, {' + '.join(digits)} AS curve FROM {at})"


def _sql() -> str:
    steps = ",\n".join(
        f"s{k} AS (SELECT v, (sum(n) OVER (ORDER BY v NULLS FIRST) - n) * {1 << BITS} // sum(n) OVER () AS x{k}"
        f" FROM (SELECT {d} AS v, count(*) AS n FROM documents GROUP BY 1))"
        for k, d in enumerate(DIMENSIONS)
    )
    joins = " ".join(f"JOIN s{k} ON s{k}.v IS NOT DISTINCT FROM d.{d}" for k, d in enumerate(DIMENSIONS))
    # CRC-32 with a table of its 256 remainders, over the bytes of the text.
    return f"""
WITH t AS (SELECT list(v ORDER BY b) AS crc FROM (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i:
    CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(b))),
d AS (SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM documents, t),
{steps},
g0 AS (SELECT doc_id, size, text_crc32, {", ".join(f"x{k}::bigint AS x{k}" for k in range(len(DIMENSIONS)))}, 0::bigint AS turn
  FROM d {joins}),
{_curve_sql()},
o AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM c),
r AS (SELECT *, place * {SHARDS} // n AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::int AS shard,
       place - (shard * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::int AS grown_shard FROM r"""


SQL = _sql()
