"""Order-dependent building blocks without a single-task window.

A window with no partition key moves every row to one task. The helpers here do the same work
over a *layout*: rows are range-partitioned and sorted by a full ordering key, and the outcome is
written once with two columns, the block (partition number) and the slot (position in it). Blocks
are balanced whatever the key distribution is, because the key includes a tie-breaker. Anything
cumulative is then a window inside a block plus one offset per block, a table that has at most as
many rows as there are partitions and is the only thing broadcast. What looks back a bounded number of
rows (``over_blocks``) needs no second order: blocks hand their last rows to the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import hour_start
from tidemark.session import materialize, small_table

BLOCK, SLOT = "_block", "_slot"
HOT_SHARE = 1000


def layout(df: DataFrame, keys: Sequence[str | Column], name: str = "layout") -> DataFrame:
    """Range-partition and sort by ``keys`` (a name: ascending, missing values last); add block and
    slot; write once."""
    keys = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys]
    position = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_position", position)
        .select(
            *df.columns,
            F.shiftright("_position", 33).cast("int").alias(BLOCK),
            F.col("_position").bitwiseAND(F.lit((1 << 33) - 1)).alias(SLOT),
        )
    )
    return materialize(placed, name)


def _with_block_starts(laid: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Add, per output name, the sum over all earlier blocks.

    One row per block reaches the driver, no more than there are partitions; a single block needs
    no offsets at all.
    """
    totals = laid.groupBy(BLOCK).agg(*[c.alias(o) for o, c in sums.items()])
    rows = sorted(totals.collect(), key=lambda r: r[BLOCK])
    if len(rows) <= 1:
        return laid.withColumns({o: F.lit(0).cast("bigint") for o in sums})
    starts, reached = [], [0] * len(sums)
    for row in rows:
        starts.append((row[BLOCK], *reached))
        reached = [a + (row[o] or 0) for a, o in zip(reached, sums)]
    schema = f"{BLOCK} int, " + ", ".join(f"{o} bigint" for o in sums)
    return laid.join(F.broadcast(small_table(laid.sparkSession, starts, schema)), BLOCK)


def with_ordinal(df: DataFrame, keys: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Add the zero-based position of each row in the total order of ``keys``."""
    placed = _with_block_starts(layout(df, keys), {"_start": F.count("*")})
    return placed.select(*df.columns, (F.col("_start") + F.col(SLOT)).alias(name))


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of whole numbers in total order, restarting for every ``by`` group.

    ``sums`` maps an output name to the column to add up. A group may span any number of blocks.
    Only the first group of a block can have started in an earlier one, so with groups at most one
    offset row per block is broadcast.
    """
    by = list(by)
    laid = layout(df, [*by, *order], "running")
    inside = Window.partitionBy(BLOCK, *by).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0)
    if by:
        placed = _with_group_starts(laid, sums, by)
    else:
        placed = _with_block_starts(laid, {f"_o_{o}": F.sum(c) for o, c in sums.items()})
    return placed.select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.coalesce(f"_o_{o}", F.lit(0))).alias(o) for o, c in sums.items()],
    )


def _with_group_starts(laid: DataFrame, sums: dict[str, str], by: Sequence[str]) -> DataFrame:
    per_block = laid.groupBy(BLOCK, *by).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        F.col(BLOCK).alias("_b"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_o_{o}") for o in sums],
        F.count("*").over(earlier).alias("_seen"),
    ).filter("_seen > 0")
    matches = F.col(BLOCK) == F.col("_b")
    for c in by:
        matches = matches & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return laid.join(F.broadcast(offsets), matches, "left")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its count ``n``. Equal values collapse before the shuffle,
    so a value held by a third of all rows costs one row per task."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def ranked_values(
    df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Distinct values with their count ``n``, the rows before them (``before``), the competition
    rank (``min_rank``, ties share the lowest) and the mid-rank (``avg_rank``)."""
    key = F.col(value).desc() if descending else F.col(value).asc()
    running = running_totals(value_counts(df, value, by), [key], {"_upto": "n"}, by)
    return running.select(
        *by,
        value,
        "n",
        (F.col("_upto") - F.col("n")).alias("before"),
        (F.col("_upto") - F.col("n") + 1).alias("min_rank"),
        (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"),
    )


def lookup(facts: DataFrame, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Bring ``columns`` of a per-value table (with row counts ``n``) to every fact row.

    Values holding more than one row in a thousand are at most a thousand in number, so they can
    always be broadcast, and the rows that have them are never shuffled. All other values are
    joined by shuffle, where none of them is heavy. Rows without a value take part in neither join.
    """
    columns = list(columns)
    wanted = [*facts.columns, *columns]
    kept = materialize(table.select(key, "n", *columns), "lookup")
    total = kept.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HOT_SHARE > total
    found = kept.filter(heavy).select(key, *columns).collect()  # fewer than HOT_SHARE rows
    if not found:
        return _lookup_by_shuffle(facts, kept.select(key, *columns), key).select(*wanted)
    hot = F.broadcast(
        small_table(
            facts.sparkSession,
            [(True, *row) for row in found],
            "_hot boolean, " + ", ".join(f"`{c}` {dict(kept.dtypes)[c]}" for c in (key, *columns)),
        )
    )
    near = facts.join(hot, key, "left").filter(F.col("_hot") | F.col(key).isNull())
    rest = facts.join(hot.select(key), key, "left_anti")
    far = _lookup_by_shuffle(rest, kept.filter(~heavy).select(key, *columns), key, skip_null=True)
    return near.select(*wanted).unionByName(far.select(*wanted))


def _lookup_by_shuffle(
    facts: DataFrame, table: DataFrame, key: str, skip_null: bool = False
) -> DataFrame:
    """Left join on a key without heavy values; rows with a null key stay out of the shuffle."""
    joined = facts.filter(F.col(key).isNotNull()).join(table, key, "left")
    if skip_null:
        return joined
    types = dict(table.dtypes)
    missing = [F.lit(None).cast(types[c]).alias(c) for c in table.columns if c != key]
    return joined.unionByName(facts.filter(F.col(key).isNull()).select("*", *missing))


def key_at(df: DataFrame, keys: Sequence[str], position: int) -> tuple | None:
    """The values of ``keys`` in the row at a zero-based position of their total order, missing values
    last; None beyond the end. The keys are range-sorted by themselves, and two rows per block at most
    reach the driver."""
    laid = layout(df.select(*keys), keys, "keys")
    blocks = laid.groupBy(BLOCK).agg(F.count("*").alias("n")).collect()
    for block in sorted(blocks, key=lambda r: r[BLOCK]):
        if position < block["n"]:
            row = laid.filter((F.col(BLOCK) == block[BLOCK]) & (F.col(SLOT) == position)).first()
            return tuple(row[k] for k in keys)
        position -= block["n"]
    return None


def time_key_at(df: DataFrame, keys: Sequence[str], share: float) -> tuple | None:
    """The key of the row at position ``int(rows * share)`` of an order that starts with a time, rows
    without a time last; None only for a table without rows.

    Rows per hour are counted first; their number is bounded by the calendar, so they may be summed
    up in one task. Only the hour that holds the position is sorted.
    """
    time = F.col(keys[0])
    hours = df.groupBy(hour_start(time).alias("hour")).agg(F.count("*").alias("n"))
    by_hour = Window.orderBy(F.col("hour").asc_nulls_last())
    upto, total = F.sum("n").over(by_hour), F.sum("n").over(Window.partitionBy())
    placed = hours.select("hour", "n", (upto - F.col("n")).alias("before"), total.alias("total"))
    wanted = F.least(F.floor(F.col("total") * F.lit(share)), F.col("total") - 1)
    spot = placed.filter(
        (F.col("before") <= wanted) & (wanted < F.col("before") + F.col("n"))
    ).withColumn("wanted", wanted).first()
    if spot is None:
        return None
    if spot["hour"] is None:
        inside = df.filter(time.isNull())
    else:
        start = constant(spot["hour"])
        inside = df.filter((time >= start) & (time < start + F.expr("INTERVAL 1 HOUR")))
    found = key_at(inside, keys, spot["wanted"] - spot["before"])
    if found is None:
        raise RuntimeError("the table changed while its split was sought")
    return found


def constant(value) -> Column:
    """A literal of a collected value; a time stays zone-free, so that comparing a stored time with
    it needs no cast of the column and reaches the scan."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def before_key(keys: Sequence[str], bound: tuple) -> Column:
    """Rows that come before ``bound`` in the total order, as a comparison with constants; missing
    values come last. A filter only: the condition is null where it is not true for a missing value."""
    condition = F.lit(False)
    for key, value in reversed(list(zip(keys, bound))):
        c = F.col(key)
        if value is None:
            condition = c.isNotNull() | condition
        else:
            condition = (c < constant(value)) | ((c == constant(value)) & condition)
    return condition


def from_key(keys: Sequence[str], bound: tuple) -> Column:
    """All other rows: ``bound`` itself and what comes behind it."""
    condition = F.lit(True)
    for key, value in reversed(list(zip(keys, bound))):
        c = F.col(key)
        if value is None:
            condition = c.isNull() & condition
        else:
            condition = (c > constant(value)) | c.isNull() | ((c == constant(value)) & condition)
    return condition


BLOCKS_PER_PARTITION = 4
MOST_BLOCKS = 1024
SAMPLES_PER_BLOCK = 16
# Shorter blocks would hand on about as many rows as they hold.
ROWS_PER_BLOCK = 1 << 15


def bisect(cuts: Column, most: int, key: Column) -> Column:
    """How many of the ascending ``cuts``, ``most`` at most, are not above a key; by halving."""
    steps = [1 << b for b in reversed(range(most.bit_length()))]

    def halve(low: Column, step: Column) -> Column:
        tried = low + step
        found = (tried <= F.size(cuts)) & (F.get(cuts, tried - 1) <= key)
        return F.when(found, tried).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def block_cuts(spark: SparkSession, value: Column) -> Column:
    """An aggregate: ascending values that cut ``value`` into blocks of about equal counts. They are
    approximate and only balance blocks, so they never decide on a result."""
    blocks = min(MOST_BLOCKS, BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return F.percentile_approx(value, [b / blocks for b in range(1, blocks)], 10 * blocks)


def point_block(cuts: Sequence[float], key: Column) -> Column:
    """The block of a key, numbered in ascending order: each cut is a block of its own (odd), the values
    between two cuts share one (even). A value above a block's share of the rows is a cut, so an
    even block is never heavy, and all rows of an odd one are equal."""
    if not cuts:
        return F.lit(0)
    held = F.expr("array({})".format(", ".join(f"double('{c!r}')" for c in cuts)))
    reached = bisect(held, len(cuts), key)
    return 2 * reached - F.when((reached > 0) & (F.get(held, reached - 1) == key), 1).otherwise(0)


class Blocks:
    """A total order cut into blocks at sampled keys.

    A row's block is the number of cuts not above its key, found by bisection in a constant of the plan.
    It follows from the row alone: whatever executor computes it, and however often, a row lands in
    the same block, and nothing has to be written before rows are exchanged by it. Cuts decide on balance
    only, never on a result. Keys are ascending, missing values last, ``series`` first.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], series: Sequence[str], lookback: int, rows: int | None):
        self.series, self.keys = list(series), [*series, *keys]
        types = dict(df.dtypes)
        self.types = [types[k] for k in self.keys]
        self.partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = BLOCKS_PER_PARTITION * self.partitions
        counted = Observation()
        sample = (
            df.select(*[F.col(k).cast("string").alias(k) for k in self.keys], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
            .observe(counted, F.count(F.lit(1)).alias("n"))
            .orderBy(F.rand(7))
            .limit(SAMPLES_PER_BLOCK * most)
            .orderBy(*[F.col(f"_k{i}").asc_nulls_last() for i in range(len(self.keys))])
            .select(*self.keys)
            .collect()
        )
        self.rows = counted.get["n"]
        wanted = rows or max(4 * lookback, ROWS_PER_BLOCK, -(-self.rows // most))
        blocks = max(1, min(len(sample), -(-self.rows // wanted)))
        picked = [tuple(sample[len(sample) * b // blocks]) for b in range(1, blocks)]
        self.cuts = [c for i, c in enumerate(picked) if i == 0 or c != picked[i - 1]]

    def _constant(self) -> Column:
        """The cuts as an array that is computed while planning, values as hexadecimal text."""

        def fields(cut: tuple) -> str:
            parts = []
            for i, (value, type_) in enumerate(zip(cut, self.types)):
                text = "NULL" if value is None else f"CAST(unhex('{value.encode().hex()}') AS STRING)"
                parts.append(f"'f{2 * i}', {str(value is None).lower()}, 'f{2 * i + 1}', CAST({text} AS {type_})")
            return f"named_struct({', '.join(parts)})"

        return F.expr(f"array({', '.join(map(fields, self.cuts))})")

    @staticmethod
    def _key(values: Sequence[Column]) -> Column:
        fields = [f.alias(f"f{2 * i + j}") for i, v in enumerate(values) for j, f in enumerate((v.isNull(), v))]
        return F.struct(*fields)

    def number(self) -> Column:
        """The block of a row."""
        if not self.cuts:
            # Zero, but of the row: a constant would make the window one without partitions in the plan.
            return F.least(F.lit(0), F.length(F.col(self.keys[0]).cast("string")))
        return bisect(self._constant(), len(self.cuts), self._key([F.col(k) for k in self.keys]))

    def name(self, left: int) -> tuple:
        return self.cuts[left][: len(self.series)]

    def crossing(self, cut: Column) -> Column:
        """Whether a row is of the series that goes across a cut; false where there is no such cut."""
        known = (cut >= 0) & (cut < len(self.cuts))
        found = F.get(self._constant(), F.when(known, cut).otherwise(F.lit(0)))
        same = known
        for i, s in enumerate(self.series):
            same = same & F.col(s).eqNullSafe(found[f"f{2 * i + 1}"])
        return same

    def sources(self, published: dict[int, int], lookback: int) -> list[tuple[int, int]]:
        """Pairs (block that publishes, block that needs it): the nearest earlier blocks of the same series
        that have ``lookback`` rows together; one pair a block unless blocks are shorter than that."""
        pairs = []
        for target in range(1, len(self.cuts) + 1):
            missing, source = lookback, target - 1
            while source >= 0 and missing > 0 and self.name(source) == self.name(target - 1):
                if published.get(source):
                    pairs.append((source, target))
                    missing -= published[source]
                source -= 1
        return pairs


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    lookback: int,
    features: Callable[[DataFrame, list[str], list[Column]], DataFrame],
    series: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Add features that look back ``lookback`` rows at most in the order of ``keys``, each series by itself.

    ``features(df, parts, order)`` adds columns by windows over ``parts`` in ``order``. It runs inside every
    block, in the one exchange of the rows, and the outcome is written. Only the first rows of a block
    lack history then. They run again behind the last ``lookback`` rows of the blocks before, which
    are published: twice ``lookback`` rows per block, whatever the size of the table. ``rows`` sets the
    rows of a block; by default there are some for every shuffle partition.
    """
    series = list(series)
    blocks = Blocks(df, keys, series, lookback, rows)
    parts, order = [BLOCK, *series], [F.col(k).asc_nulls_last() for k in keys]
    inside = Window.partitionBy(*parts).orderBy(*order)
    marked = df.withColumn(BLOCK, blocks.number())
    if not blocks.cuts:
        return features(marked, parts, order).drop(BLOCK)
    # A stated number, or small tables would be written by one task.
    marked = marked.repartition(min(blocks.partitions, len(blocks.cuts) + 1), BLOCK)
    first = (F.row_number().over(inside) <= lookback) & blocks.crossing(F.col(BLOCK) - 1)
    last = F.lead(F.lit(1), lookback).over(inside).isNull() & blocks.crossing(F.col(BLOCK))
    done = features(marked.withColumns({"_first": first, "_last": last}), parts, order)
    written = materialize(done, "blocks")
    published = written.filter("_last").groupBy(BLOCK).count().collect()  # a row per block
    pairs = blocks.sources({r[BLOCK]: r["count"] for r in published}, lookback)
    targets: dict[int, list[int]] = {}
    for source, target in pairs:
        targets.setdefault(source, []).append(target)
    places = small_table(df.sparkSession, [(s, ",".join(map(str, t))) for s, t in targets.items()], f"{BLOCK} int, _targets string")
    # Block ends in one scan: the first rows for their own block, the last ones for those that need them.
    ends = written.filter("_first OR _last").join(F.broadcast(places), BLOCK, "left")
    here = F.when(F.col("_first"), F.array(F.struct(F.col(BLOCK).alias(BLOCK), F.lit(True).alias("_owned"))))
    there = F.when(
        F.col("_last"),
        F.transform(F.split("_targets", ","), lambda t: F.struct(t.cast("int").alias(BLOCK), F.lit(False).alias("_owned"))),
    )
    none = F.array().cast(f"array<struct<{BLOCK}: int, _owned: boolean>>")
    roles = F.concat(F.coalesce(here, none), F.coalesce(there, none))
    mended = features(ends.select(*df.columns, F.inline(roles)), parts, order).filter("_owned")
    helpers = [BLOCK, "_first", "_last", "_owned"]
    return written.filter("NOT _first").drop(*helpers).unionByName(mended.drop(*helpers))


def halo_chunks(
    df: DataFrame, lookback: int, chunk_rows: int = 8192, ordinal: str = "ordinal"
) -> DataFrame:
    """Cut the total order into chunks of equal size, each preceded by the ``lookback`` rows before
    it. A frame of at most ``lookback`` preceding rows is then exact inside one chunk. Adds
    ``chunk`` and ``owned``; keep owned rows only once the windows are computed.
    """
    size = max(chunk_rows, lookback)
    home = F.floor(F.col(ordinal) / size)
    own = F.struct(home.alias("chunk"), F.lit(True).alias("owned"))
    ahead = F.struct((home + 1).alias("chunk"), F.lit(False).alias("owned"))
    near_end = F.pmod(F.col(ordinal), F.lit(size)) >= size - lookback
    return df.select("*", F.inline(F.when(near_end, F.array(own, ahead)).otherwise(F.array(own))))
