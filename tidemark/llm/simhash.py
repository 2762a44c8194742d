"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints have 64 bits. From the bit and pair frequencies of all distinct fingerprints (2,080
counts, added up on the executors) correlated bits are grouped into partitions. For each fingerprint a
dynamic programme allots thresholds T to the partitions, unequal and -1 for "not probed", whose sum is
``limit - partitions + 1`` and whose estimated cost is least: whatever differs in at most ``limit`` bits
then differs in at most T bits of some partition. Every fingerprint is indexed by its value in each
partition; each probes the values within its thresholds, and the join keeps verified pairs only.

Copies share a fingerprint and count once. An index value that more than ``LARGE_VALUE`` fingerprints
share would make a square number of candidates; such fingerprints, and those that probe it, are linked
exactly in another way: two fingerprints are within 4 bits exactly if some point is within 2 bits of
both, so each names the 2,081 points around it and is linked to the smallest one that names the same
point. No point has more than 2,081 neighbours, so no group is large and no pair is emitted.

Components of the links come from alternating large-star and small-star rounds, each a written table;
links are reduced to a forest inside each task first.

Defined cases: a null or empty text has no words and the fingerprint 0, and is linked like any other;
shorter texts than a shingle are one shingle; rows that repeat an id are marked alike; rows with a null
id get the component of their fingerprint, whose id is the smallest that is not null; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (
    bit_set,
    columns,
    documents,
    fresh,
    join_with_large_keys,
    python_ready,
    quoted,
    text_of,
)
from tidemark.session import materialize

BITS = 64
LIMIT = 4
SHINGLE = 4
SEED = 42
LARGE_VALUE = 2048
# Maps of 4 KiB, each for 32,768 rows of a file, that are broadcast: 32 MiB at most.
MAPS_AT_ONCE = 8192
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of the word shingles of a text, as an unsigned integer."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    hashed = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(starts)
    for k in range(0, n, _CHUNK):
        pairs = zip(starts[k : k + _CHUNK], ends[k + width - 1 : k + width - 1 + _CHUNK])
        values = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in pairs), np.uint64)
        total += _bits(values).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each value, the lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(text: Column) -> Column:
    """Fingerprints as signed 64-bit integers with the same bits."""

    @F.arrow_udf("bigint")
    def compute(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint((t.as_py() or "").encode()) for t in texts], np.uint64)
        return pa.array(values.view(np.int64))

    return compute(text)


# --- partitions and thresholds -------------------------------------------------------------------


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, how many have both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), _CHUNK):
                bits = _bits(values[k : k + _CHUNK]).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
            n += len(values)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.record_batch(
                [pa.array([*i, -1], pa.int32()), pa.array([*j, -1], pa.int32()), pa.array([*both[i, j], n], pa.int64())],
                names=["i", "j", "n"],
            )

    rows = distinct.select("fp").mapInArrow(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    n, both = 0, np.zeros((BITS, BITS))
    for row in rows.collect():  # 2,081 rows at most
        if row.i < 0:
            n = row.n
        else:
            both[row.i, row.j] = both[row.j, row.i] = row.n
    return n, both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (related[b, rest].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near_values(width: int, distance: int) -> int:
    return sum(math.comb(width, d) for d in range(distance + 1))


def partition_count(n: int, limit: int = LIMIT) -> int:
    """The number of partitions with the least probes and candidates, were all bits fair."""

    def cost(m: int) -> float:
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        options = (t for t in itertools.product(range(limit + 1), repeat=m) if sum(t) == limit - m + 1)
        return min(sum(near_values(w, t) * (1 + n / 2**w) for w, t in zip(widths, ts)) for ts in options)

    return min(range(2, limit + 2), key=cost)


class Probing:
    """Partitions of the bits, and the index values and probes of a fingerprint."""

    def __init__(self, n: int, both: np.ndarray, limit: int = LIMIT, m: int | None = None):
        self.n, self.limit = n, limit
        self.groups = correlated_groups(n, both, m or partition_count(n, limit))
        self.share = np.clip(np.diag(both) / max(n, 1), 1e-3, 1 - 1e-3)

    def values(self, bits: np.ndarray) -> list[np.ndarray]:
        """The value of each partition with the partition's number above it."""
        return [
            (bits[:, g].astype(np.int64) << np.arange(len(g))).sum(axis=1) | (k << 40) for k, g in enumerate(self.groups)
        ]

    def _costs(self, bits: np.ndarray, group: list[int]) -> np.ndarray:
        """Estimated candidates and probes for thresholds -1 to the limit (by row)."""
        differ = np.where(bits[:, group] == 1, 1 - self.share[group], self.share[group])
        chance = np.zeros((self.limit + 1, len(bits)))
        chance[0] = 1
        for b in range(len(group)):
            chance[1:] = chance[1:] * (1 - differ[:, b]) + chance[:-1] * differ[:, b]
            chance[0] *= 1 - differ[:, b]
        probes = np.array([near_values(len(group), d) for d in range(self.limit + 1)])
        return np.vstack([np.zeros(len(bits)), np.cumsum(chance, axis=0) * self.n + probes[:, None]])

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """For each fingerprint (row) the threshold of each partition with the least cost."""
        m, steps = len(self.groups), self.limit + 2
        # Thresholds count from 0 here; with m partitions they then add up to limit + 1.
        most = self.limit + 1
        best = np.full((most + 1, len(bits)), np.inf)
        best[0] = 0
        chosen = []
        for group in self.groups:
            cost = self._costs(bits, group)
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for total in range(most + 1):
                for t in range(min(total, steps - 1) + 1):
                    value = best[total - t] + cost[t]
                    less = value < new[total]
                    new[total][less], pick[total][less] = value[less], t
            best = new
            chosen.append(pick)
        out, left, rows = np.zeros((len(bits), m), np.int64), np.full(len(bits), most), np.arange(len(bits))
        for k in range(m - 1, -1, -1):
            out[:, k] = chosen[k][left, rows]
            left = left - out[:, k]
        return out - 1

    def probes(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and the index values that these rows ask for."""
        bits = _bits(values)
        own, limits = self.values(bits), self.thresholds(bits)
        for k, group in enumerate(self.groups):
            for t in range(self.limit + 1):
                rows = np.flatnonzero(limits[:, k] == t)
                if len(rows):
                    flips = masks(len(group), t)
                    yield np.repeat(rows, len(flips)), (own[k][rows][:, None] ^ flips[None, :]).ravel()


def masks(width: int, distance: int) -> np.ndarray:
    """All integers of ``width`` bits with at most ``distance`` of them set."""
    found = [0]
    for d in range(1, distance + 1):
        found += [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), d)]
    return np.array(found, np.uint64).view(np.int64)


# --- links ------------------------------------------------------------------------------------------


def _rows_of(make, schema: str):
    """A mapInArrow function from fingerprints to rows (fp, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fps), 4096):
                part = fps[k : k + 4096]
                for rows, keys in make(part.view(np.uint64)):
                    yield pa.record_batch([pa.array(part[rows]), pa.array(keys)], names=["fp", "key"])

    return lambda df: df.select("fp").mapInArrow(run, schema)


def links(distinct: DataFrame, limit: int = LIMIT, large_value: int = LARGE_VALUE) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``limit`` bits, a < b; those around large index values are
    replaced by links to the smallest fingerprint near a common point, with the same components."""
    n, both = bit_statistics(distinct)
    probing = Probing(n, both, limit)

    def index(values):
        for keys in probing.values(_bits(values)):
            yield np.arange(len(values)), keys

    indexed = _rows_of(index, "fp bigint, key bigint")(distinct)
    asked = _rows_of(probing.probes, "fp bigint, key bigint")(distinct)
    large = indexed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > large_value).select("key")
    large = materialize(large, "large-values")
    around = None
    if not large.isEmpty():
        if limit % 2:
            raise ValueError("large index values need an even limit")
        near = asked.unionByName(indexed).join(large, "key", "left_semi").select("fp").distinct()
        around = _links_by_points(near, limit)
        indexed, asked = indexed.join(large, "key", "left_anti"), asked.join(large, "key", "left_anti")
    pairs = asked.withColumnRenamed("fp", "a").join(indexed.withColumnRenamed("fp", "b"), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    pairs = pairs.filter((F.col("a") < F.col("b")) & near).select("a", "b")
    return pairs if around is None else pairs.unionByName(around)


def _links_by_points(fps: DataFrame, limit: int) -> DataFrame:
    flips = masks(BITS, limit // 2)

    def ball(values):
        own = values.view(np.int64)
        for k in range(0, len(own), 64):
            part = np.arange(k, min(k + 64, len(own)))
            yield np.repeat(part, len(flips)), (own[part][:, None] ^ flips[None, :]).ravel()

    points = _rows_of(ball, "fp bigint, key bigint")(fps)
    met = points.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    pairs = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, len(flips))).alias("b"))
    return pairs.distinct()


# --- components -------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task reduced to one per node: to the smallest node it reaches in this task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.record_batch(
        [pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())], names=["a", "b"]
    )


def _with_lowest(links_: DataFrame) -> DataFrame:
    """Links (a, b) with the smallest ``b`` of each ``a`` as ``m``; a node with very many links is no hot key."""
    low = links_.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    low = materialize(low, "lowest")
    return join_with_large_keys(links_, low, "a", "n", low.agg(F.sum("n")).first()[0] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node of the component."""
    schema = "a bigint, b bigint"
    links_ = materialize(edges.select("a", "b").mapInArrow(_forest, schema), "links")
    state = None
    while True:
        both = links_.unionByName(links_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: the larger neighbours of a node go to the smallest node around it.
        large = _with_lowest(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        small = _with_lowest(materialize(large, "large-star"))
        star = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        links_ = materialize(star.distinct(), "links")
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = links_.agg(F.count("*").alias("n"), digest.alias("h")).first()
        if state == now:
            break
        state = now
    roots = links_.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links_.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, fp (64 bits as a signed integer) and component_id, the smallest id reachable."""
    python_ready(df.sparkSession)
    rows = materialize(df.select(quoted(id_).alias("id"), fingerprints(text_of(text)).alias("fp")), "fingerprints")
    return _grouped(rows, limit).select(F.col("id").alias(id_), "fp", "component_id")


def _grouped(rows: DataFrame, limit: int = LIMIT, least: int = 1) -> DataFrame:
    """Written ``rows`` (id, fp and others) with root, which tells the component, and component_id; only
    those of components with ``least`` rows or more."""
    per_fp = rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    per_fp = materialize(per_fp, "distinct-fingerprints")
    found = materialize(components(links(per_fp, limit)), "components")
    rooted = per_fp.join(found, per_fp["fp"] == found["node"], "left")
    rooted = materialize(rooted.select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count("*").alias("m"), F.sum("n").alias("rows")
    )
    named = materialize(named, "component-ids")
    table = join_with_large_keys(rooted, named, "root", "m", rooted.count()).filter(F.col("rows") >= least)
    table = materialize(table.select("fp", "root", "component_id", "n"), "fingerprint-components")
    return join_with_large_keys(rows, table, "fp", "n", rows.count())


def scanned_rows(df: DataFrame) -> tuple[Column, Column] | None:
    """File and position of the rows of a table read from Parquet files, which name a row alike at each
    reading; None for other tables."""
    try:
        place = df.metadataColumn("_metadata")
        named = place["file_path"], place["row_index"]
        df.select(*named)
    except AnalysisException:
        return None
    return named


def one_of_each(
    df: DataFrame, id_: str = "doc_id", text: str = "text", named: tuple[Column, Column] | None = None
) -> DataFrame:
    """One row of each component of ``df``: that with the smallest id, nulls last, then the smallest hash of
    the text. Ids may repeat or be null. Rows are told apart by ``named``, a text and a whole number that
    each reading of ``df`` gives them again (see :func:`scanned_rows`). Without it, rows are numbered and
    the whole table is written with the numbers.

    Rows that go are bits in maps per text and range of numbers. The table does not shuffle as long as the
    maps stay within ``MAPS_AT_ONCE``; beyond, both sides shuffle by the name of the row."""
    python_ready(df.sparkSession)
    place, number = fresh(df, "place", "number")
    if named is None:
        df_named = df.withColumn(place, F.lit("")).withColumn(number, F.monotonically_increasing_id())
        df_named = materialize(df_named, "numbered")
    else:
        df_named = df.select("*", named[0].alias(place), named[1].alias(number))
    t = text_of(text)
    rows = df_named.select(
        quoted(id_).alias("id"),
        fingerprints(t).alias("fp"),
        F.xxhash64(t).alias("tie"),
        quoted(place).alias("place"),
        quoted(number).alias("number"),
    )
    marked = _grouped(materialize(rows, "fingerprints"), least=2).select("root", "id", "tie", "place", "number")
    marked = materialize(marked, "grouped")
    first = F.min(F.struct(F.col("id").isNull(), "id", "tie", "place", "number"))
    kept = marked.groupBy("root").agg(first.alias("first")).select("first.place", "first.number")
    gone = materialize(marked.select("place", "number").join(kept, ["place", "number"], "left_anti"), "near-duplicates")
    return _without(df_named, place, number, gone).select(*columns(df.columns))


def _without(df: DataFrame, place: str, number: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose (place, number) is not among the written rows ``gone``."""
    maps = gone.groupBy("place", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )
    maps = materialize(maps, "gone-maps")
    if maps.count() > MAPS_AT_ONCE:
        p, n = fresh(df, "gone_place", "gone_number")
        gone = gone.select(F.col("place").alias(p), F.col("number").alias(n))
        return df.join(gone, (quoted(place) == F.col(p)) & (quoted(number) == F.col(n)), "left_anti")
    p, b, bits = fresh(df, "map_place", "map_bucket", "map_bits")
    maps = maps.select(F.col("place").alias(p), F.col("bucket").alias(b), F.col("bits").alias(bits))
    same = (quoted(place) == F.col(p)) & (F.bitmap_bucket_number(quoted(number)) == F.col(b))
    return df.join(F.broadcast(maps), same, "left").filter(
        ~bit_set(F.col(bits), F.bitmap_bit_position(quoted(number)))
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` as the stage before wrote it: its files are read twice, the corpus is not written again."""
    return one_of_each(docs, named=scanned_rows(docs))


def op4_simhash(spark, folder: str) -> DataFrame:
    marked = near_duplicates(documents(spark, folder))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.select("doc_id", digits.alias("fingerprint"), "component_id")
