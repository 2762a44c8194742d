"""Exact deduplication behind a two-pass Bloom filter, in DataFrame and SQL functions alone.

Texts are equal when they are identical after deleting white space; equality is decided by the
SHA-256 of the normalised text. Pass one counts how often each filter cell is hit (two cells a row,
combined map-side, so a text that a third of all rows share costs one row per task) and keeps the
cells hit twice or more as bitmaps. Pass two tests each row against the bitmaps: a row with a cell
that only it hits is unique and passes straight through; only possibly repeated rows shuffle.

The bitmaps are broadcast. Their size is ``2 bytes x rows`` up to a power of two, and ``MAX_CELLS / 8``
bytes (16 MiB) at most; beyond that more rows count as possibly repeated and shuffle their digest,
and results stay exact. Groups holding a thousandth of all rows or more (there are 1000 at most) are
joined by broadcast, so no task gets all rows of a large group.

Defined cases: a null text counts as empty, and all empty texts are one group; of equal texts the row
with the most code points stays, then the smallest id, a null id last; rows that repeat id and length
too are marked alike by ``mark`` and come out once from ``distinct_texts``; an empty table gives an
empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, bit_set, columns, documents, fresh, quoted, text_of
from tidemark.session import materialize

CELLS_PER_ROW = 16
MAX_CELLS = 1 << 27
HOT_SHARE = 1000


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, BLANK + "+", ""), 256)


def _cells(sha: Column, n_cells: int) -> list[Column]:
    return [F.conv(F.substring(sha, start, 12), 16, 10).cast("bigint") % n_cells for start in (1, 13)]


class RepeatFilter:
    """The cells that rows of ``digests`` (column ``sha``) hit twice or more."""

    def __init__(self, digests: DataFrame):
        self.rows = digests.count()
        wanted = CELLS_PER_ROW * max(self.rows, 1)
        self.n_cells = min(MAX_CELLS, max(1 << 15, 1 << (wanted - 1).bit_length()))
        hit = digests.select(F.explode(F.array(*_cells(F.col("sha"), self.n_cells))).alias("cell"))
        twice = hit.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
        maps = twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
        )
        self.maps = materialize(maps, "repeat-filter")

    def probe(self, df: DataFrame, sha: str, out: str) -> DataFrame:
        """``df`` with a flag that is false only for rows whose digest occurs once."""
        own = [c for c in df.columns]
        flags = []
        for k, cell in enumerate(_cells(quoted(sha), self.n_cells)):
            bucket, of, bits = fresh(df, f"bucket_{k}", f"bucket_{k}_of", f"bits_{k}")
            maps = F.broadcast(self.maps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
            df = df.withColumn(of, F.bitmap_bucket_number(cell))
            df = df.join(maps, F.col(of) == F.col(bucket), "left")
            flags.append(bit_set(F.col(bits), F.bitmap_bit_position(cell)))
        return df.select(*columns(own), (flags[0] & flags[1]).alias(out))


def _rank(n_chars: str, id_: str) -> Column:
    return F.struct((-quoted(n_chars)).alias("a"), quoted(id_).isNull().alias("b"), quoted(id_).alias("c"))


class Groups:
    """What is known of the repeated texts of a table: the filter and a row for each repeated digest."""

    def __init__(self, df: DataFrame, id_: str, text: str):
        t = text_of(text)
        digests = df.select(quoted(id_).alias("id"), digest(t).alias("sha"), F.length(t).alias("n"))
        self.digests = materialize(digests, "digests")
        self.filter = RepeatFilter(self.digests)
        probed = self.filter.probe(self.digests, "sha", "maybe")
        self.marked = materialize(probed, "probed-digests")
        self.maybe = self.marked.filter("maybe")
        groups = self.maybe.groupBy("sha").agg(
            F.min(_rank("n", "id")).alias("best"), F.count("*").alias("group_size")
        )
        self.groups = materialize(groups.filter("group_size > 1"), "repeated-digests")
        self.hot = self.groups.filter(F.col("group_size") * HOT_SHARE >= self.filter.rows)
        self.rest = self.groups.filter(F.col("group_size") * HOT_SHARE < self.filter.rows)

    def join(self, df: DataFrame, sha: str) -> DataFrame:
        """Possibly repeated rows with ``best`` and ``group_size`` of their group, null for single ones."""
        (key,) = fresh(df, "group_sha")
        hot, rest = (g.withColumnRenamed("sha", key) for g in (self.hot, self.rest))
        same = quoted(sha) == F.col(key)
        large = df.join(F.broadcast(hot), same, "inner").drop(key)
        others = df.join(F.broadcast(hot), same, "left_anti")
        return large.unionByName(others.join(rest, same, "left").drop(key))


def mark(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, the id that stays, the group's size, whether it stays, its digest."""
    found = Groups(df, id_, text)
    single = found.marked.filter("NOT maybe").select("id", "sha", "n")
    grouped = found.join(found.maybe.select("id", "sha", "n"), "sha")
    single = single.withColumn("best", _rank("n", "id")).withColumn("group_size", F.lit(1).cast("bigint"))
    rows = single.unionByName(grouped)
    best = F.coalesce("best", _rank("n", "id"))
    return rows.select(
        F.col("id").alias(id_),
        best["c"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (best == _rank("n", "id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_texts(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text stays, each group once, with the columns of ``df``."""
    found = Groups(df, id_, text)
    sha, n, maybe, best, size = fresh(df, "row_sha", "row_chars", "row_maybe", "best", "group_size")
    if (best, size) != ("best", "group_size"):
        found.hot, found.rest = (
            g.withColumnsRenamed({"best": best, "group_size": size}) for g in (found.hot, found.rest)
        )
    t = text_of(text)
    rows = found.filter.probe(df.withColumn(sha, digest(t)).withColumn(n, F.length(t)), sha, maybe)
    own = columns(df.columns)
    single = rows.filter(~quoted(maybe)).select(*own)
    grouped = found.join(rows.filter(quoted(maybe)), sha)
    staying = grouped.filter(quoted(best).isNull() | (quoted(best) == _rank(n, id_)))
    return single.union(staying.dropDuplicates([sha]).select(*own))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_texts(docs)


def op3_exact_dedup(spark, folder: str) -> DataFrame:
    return mark(documents(spark, folder))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""
