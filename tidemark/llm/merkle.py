"""Merkle manifest: a tree over the rows of a dataset, stored as parent-linked node rows, and its climb.

Every row is a leaf, the SHA-256 of its fields. Leaves of a partition (``by``) are ordered by id; each run
of eight neighbours hashes to a node of the next level until one is left, the partition's subroot. Subroots
in order of their partition are the leaves of one more tree, whose last node is the root. Digests are
hashed as lowercase hex text and kept as 32 bytes.

``build`` writes one row per node but the root: the node, its parent, its seat in the run and the digests
of the whole run. ``climb`` is a recursive query over these rows. A climbing row stands for the leaves of
one run, which share all ancestors: it holds a folded digest for each of them and the siblings met so far,
which saves seven eighths of the rows that every round shuffles. Each round joins a row's node, replaces the
node's digest in the run by every folded digest, hashes, and appends the siblings.

What holds at size: places inside a partition are running totals over range-sorted blocks, so a partition
with a third of all rows is many tasks. A node above a thousandth of all leaves or more is the join key
of many climbing rows; there are at most a thousand of them per level, so a second recursive query
joins those by broadcast, and the first one, by shuffle, stops below them. A level is written before the
next is built, and Spark keeps each round of a recursive query as shuffle files, so a lost executor costs
its own part of one round. No step depends on the number of levels but by the number of rounds, the
logarithm of the rows to base eight.

Defined cases: a null field counts as ``-`` and differs from an empty one; the null partition comes first;
rows with equal ids follow their digest, null ids come first, equal rows are leaves of their own; a
partition of one row has its leaf as subroot, a table of one partition its subroot as root; an empty table
has no leaves, no nodes and no root, and its result is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, documents, quoted
from tidemark.operators.ordering import running_totals, with_ordinal
from tidemark.session import materialize

FAN = 8
HOT_SHARE = 1000
TOP = "^"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def _hash(digests: Column) -> Column:
    """The digest of digests put one after the other."""
    return F.unhex(F.sha2(_hex(digests), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _seat(seat: Column) -> Column:
    return (seat * 32 + 1).cast("int")


def _fold(run: Column, seat: Column, digest: Column) -> Column:
    """The digest of a run in which one seat is replaced."""
    return _hash(F.overlay(run, digest, _seat(seat), F.lit(32)))


def _others(run: Column, seat: Column) -> Column:
    return F.overlay(run, F.lit(b""), _seat(seat), F.lit(32))


def _name(tree: Column, level: int, place: Column) -> Column:
    return F.concat(tree, F.lit(f"/{level}/"), place.cast("string"))


def leaves(
    df: DataFrame, by: str, id_: str, fields: Sequence[str], given: dict[str, Column] | None = None
) -> DataFrame:
    """One narrow row per row of ``df``: tree, id, leaf digest, and as ``given`` the digest in which the
    fields named by ``given`` have other values. Written, with a row number that breaks the last ties."""
    given = given or {}
    tree = F.coalesce(F.concat(F.lit("="), quoted(by).cast("string")), F.lit("-"))
    original = _digest([quoted(f) for f in fields])
    other = _digest([given.get(f, quoted(f)) for f in fields]) if given else original
    rows = df.select(
        tree.alias("tree"), quoted(id_).alias("id"), original.alias("hash"), other.alias("given"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(rows, "leaves")


@dataclass
class Manifest:
    """The stored tree: ``links`` has a row per node but the root, ``runs`` the runs of leaves."""

    runs: DataFrame
    links: DataFrame
    leaves: int
    root: str | None
    root_node: str | None


def _placed(rows: DataFrame) -> DataFrame:
    """Leaves with their place, from 0, among those of their tree."""
    order = [F.col("id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()]
    counted = running_totals(rows.withColumn("one", F.lit(1)), order, {"upto": "one"}, ["tree"])
    return counted.select("tree", (F.col("upto") - 1).alias("place"), "id", "hash", "given")


def _runs(level: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each run of neighbours as one row: tree, run, the members in order, their digests, their leaves."""
    run = F.floor(F.col("place") / FAN)
    grouped = level.groupBy("tree", run.alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("place", *columns))).alias("members"),
        F.sum("leaves").alias("leaves"),
    )
    return grouped.select(
        "*", F.aggregate("members", F.lit(b""), lambda a, m: F.concat(a, m["hash"])).alias("run_hashes")
    )


def _finished() -> Column:
    """A run that is a whole level: its one member has no parent in the tree."""
    return (F.col("run") == 0) & (F.size("members") == 1)


def _links(runs: DataFrame, level: int, entry: bool) -> DataFrame:
    """The members of runs as node rows, linked to their parent; entries of the top tree are subroots."""
    member = F.col("m")
    return runs.filter(~_finished()).select(
        "tree", "run", "run_hashes", F.col("leaves").alias("parent_leaves"), F.explode("members").alias("m")
    ).select(
        member["node"].alias("node"),
        _name(F.col("tree"), level + 1, F.col("run")).alias("parent"),
        (member["place"] % FAN).cast("int").alias("seat"),
        F.col("run_hashes").alias("run"),
        (member["hash"] if entry else F.lit(None).cast("binary")).alias("subroot"),
        member["leaves"].alias("leaves"),
        "parent_leaves",
    )


def _next_level(runs: DataFrame, level: int) -> DataFrame:
    return runs.filter(~_finished()).select(
        "tree",
        F.col("run").alias("place"),
        _name(F.col("tree"), level + 1, F.col("run")).alias("node"),
        _hash(F.col("run_hashes")).alias("hash"),
        "leaves",
    )


def _ends(runs: DataFrame) -> DataFrame:
    last = F.col("members")[0]
    return runs.filter(_finished()).select(
        "tree", last["node"].alias("node"), last["hash"].alias("hash"), last["leaves"].alias("leaves")
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _grow(level: DataFrame, columns: Sequence[str], height: int = 0, entry: bool = False):
    """Build all levels above ``level``; each is written. Returns the runs of the first level, the links
    of all, and the last nodes of the trees."""
    first, links, ends = None, [], []
    while True:
        runs = materialize(_runs(level, columns if first is None else ("node", "hash", "leaves")), "merkle-runs")
        if first is None:
            first = runs
        elif runs.isEmpty():
            break
        links.append(_links(runs, height, entry and runs is first))
        ends.append(_ends(runs))
        level, height = _next_level(runs, height), height + 1
    return first, links, _union(ends)


def build(rows: DataFrame) -> Manifest:
    """The manifest of written ``leaves``."""
    level = _placed(rows).withColumns({"node": _name(F.col("tree"), 0, F.col("place")), "leaves": F.lit(1).cast("bigint")})
    runs, links, ends = _grow(level, ("id", "node", "hash", "given", "leaves"))
    subroots = materialize(ends, "merkle-subroots")
    # '-', the null partition, sorts before every '=...'.
    seated = with_ordinal(subroots, ["tree"], "place")
    top = seated.select(F.lit(TOP).alias("tree"), "place", "node", "hash", "leaves")
    _, above, root = _grow(top, ("node", "hash", "leaves"), entry=True)
    # Leaves themselves need no row: their run is where a climb starts. A lone leaf is linked as a subroot.
    stored = materialize(_union(links[1:] + above), "merkle-nodes")
    found = root.select("node", _hex(F.col("hash")).alias("root"), "leaves").first()
    if found is None:
        return Manifest(runs, stored, 0, None, None)
    return Manifest(runs, stored, found["leaves"], found["root"], found["node"])


def _starts(manifest: Manifest) -> DataFrame:
    """One climbing row per run of leaves, already folded once where the run has a parent."""
    alone = _finished()
    parent = F.when(alone, F.col("members")[0]["node"]).otherwise(_name(F.col("tree"), 1, F.col("run")))
    run = F.col("run_hashes")

    def climber(m: Column) -> Column:
        seat = m["place"] % FAN
        folded = F.when(alone, m["given"]).otherwise(_fold(run, seat, m["given"]))
        return F.struct(m["id"].alias("id"), seat.cast("int").alias("seat"), folded.alias("digest"))

    return manifest.runs.select(
        parent.alias("node"),
        F.transform("members", climber).alias("climbers"),
        run.alias("leaf_run"),
        F.lit(b"").alias("siblings"),
        F.lit(None).cast("binary").alias("subroot"),
        (F.col("leaves") * HOT_SHARE >= manifest.leaves).alias("stop"),
    )


_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT node, climbers, leaf_run, siblings, subroot, stop FROM {starts}
  UNION ALL
  SELECT {hint} n.parent,
         transform(c.climbers, x -> named_struct('id', x.id, 'seat', x.seat, 'digest',
           unhex(sha2(lower(hex(overlay(n.run PLACING x.digest FROM 32 * n.seat + 1 FOR 32))), 256)))),
         c.leaf_run,
         concat(c.siblings, overlay(n.run PLACING X'' FROM 32 * n.seat + 1 FOR 32)),
         coalesce(c.subroot, n.subroot),
         n.stop
  FROM climb c JOIN {links} n ON c.node = n.node)
SELECT * FROM climb"""


@contextmanager
def _unlimited(spark: SparkSession):
    """Recursive queries stop at a million rows unless they are told otherwise."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def climb(manifest: Manifest) -> DataFrame:
    """A row per leaf: id, leaf, subroot, root, the digest of its proof, the root folded from ``given``
    and the proof, and whether it is the manifest's root."""
    spark = manifest.runs.sparkSession
    weight = F.col("leaves") * HOT_SHARE
    stop = (F.col("parent_leaves") * HOT_SHARE >= manifest.leaves).alias("stop")
    links = manifest.links.select("*", stop)
    low, high = links.filter(weight < manifest.leaves), links.filter(weight >= manifest.leaves)
    with _unlimited(spark):
        query = _CLIMB.format(starts="{starts}", links="{links}", hint="")
        met = materialize(spark.sql(query, starts=_starts(manifest), links=low).filter("stop"), "merkle-climb")
        # Nodes with a thousandth of all leaves: at most HOT_SHARE in each level.
        query = _CLIMB.format(starts="{starts}", links="{links}", hint="/*+ BROADCAST(n) */")
        reached = F.col("node") == F.lit(manifest.root_node)
        top = materialize(spark.sql(query, starts=met, links=high).filter(reached), "merkle-top")
    leaf_run, x = F.col("leaf_run"), F.col("x")
    proof = F.concat(_others(leaf_run, x["seat"]), F.col("siblings"))
    root = F.lit(manifest.root).cast("string")
    folded = _hex(x["digest"])
    return top.select("*", F.explode("climbers").alias("x")).select(
        x["id"].alias("id"),
        _hex(F.substring(leaf_run, _seat(x["seat"]), F.lit(32))).alias("leaf"),
        F.coalesce(_hex(F.col("subroot")), root).alias("subroot"),
        root.alias("root"),
        F.sha2(_hex(proof), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )


def verify(
    df: DataFrame, given: dict[str, Column], by: str = "lang", id_: str = "doc_id", fields: Sequence[str] = FIELDS
) -> DataFrame:
    """Build the manifest of ``df`` and climb from rows whose fields have the values of ``given``."""
    return climb(build(leaves(df, by, id_, fields, given))).withColumnRenamed("id", id_)


def op11_merkle(spark, folder: str) -> DataFrame:
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return verify(documents(spark, folder), {"text": F.when(third, lower).otherwise(F.col("text"))})


_PART = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {" || ".join(_PART.format(f) for f in FIELDS[:4])} AS head, text,
         CASE WHEN ({crc32_sql("doc_id::varchar")}) % 3 = 0 THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END AS given
  FROM documents),
l AS (SELECT doc_id, lang, sha256(head || {_PART.format("text")}) AS leaf, sha256(head || {_PART.format("given")}) AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
nodes AS (
  SELECT lang, 0 AS level, place, leaf AS h FROM p
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, max(place) OVER (PARTITION BY lang) AS last FROM nodes) WHERE last > 0 GROUP BY lang, level, place // 8),
subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM nodes) WHERE level = top),
tops AS (
  SELECT 0 AS level, place, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, max(place) OVER () AS last FROM tops) WHERE last > 0 GROUP BY level, place // 8),
up AS (
  SELECT doc_id, leaf, lang, 0 AS level, place, changed AS digest, '' AS siblings FROM p
  UNION ALL
  SELECT u.doc_id, u.leaf, u.lang, u.level + 1, u.place // 8,
         sha256(string_agg(CASE WHEN n.place = u.place THEN u.digest ELSE n.h END, '' ORDER BY n.place)),
         u.siblings || coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place <> u.place), '')
  FROM up u JOIN nodes n ON n.lang IS NOT DISTINCT FROM u.lang AND n.level = u.level AND n.place // 8 = u.place // 8
  WHERE EXISTS (SELECT 1 FROM nodes o WHERE o.lang IS NOT DISTINCT FROM u.lang AND o.level = u.level + 1)
  GROUP BY u.doc_id, u.leaf, u.lang, u.level, u.place, u.digest, u.siblings),
mid AS (
  SELECT u.doc_id, u.leaf, u.lang, u.digest, u.siblings, s.subroot, s.place
  FROM (SELECT *, max(level) OVER (PARTITION BY doc_id, leaf, lang) AS top FROM up) u
  JOIN subs s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.level = u.top),
up2 AS (
  SELECT doc_id, leaf, subroot, 0 AS level, place, digest, siblings FROM mid
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.level + 1, u.place // 8,
         sha256(string_agg(CASE WHEN n.place = u.place THEN u.digest ELSE n.h END, '' ORDER BY n.place)),
         u.siblings || coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place <> u.place), '')
  FROM up2 u JOIN tops n ON n.level = u.level AND n.place // 8 = u.place // 8
  WHERE EXISTS (SELECT 1 FROM tops o WHERE o.level = u.level + 1)
  GROUP BY u.doc_id, u.leaf, u.subroot, u.level, u.place, u.digest, u.siblings),
r AS (SELECT h AS root, level AS top FROM tops ORDER BY level DESC LIMIT 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM up2, r WHERE level = top"""
