"""Conversation prefix trie, from adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes, big-endian, of the SHA-256 of its role and text. A conversation's key is
the ids of its turns one after the other, after an id of zeros that stands for the textless root. Keys are
range-sorted, and every task puts the keys it gets into an adaptive radix tree (``radix``): node layouts
grow with their children, shared bytes are compressed, and only depths at a turn's end become trie nodes.

No task needs a whole subtree or a whole conversation:

* Keys are cut into parts of ``SPAN`` turns. A part's tree is that of the prefix before it, so a conversation
  with a third of all turns is many keys. Depths and prefix names of a conversation are running totals over
  range-sorted blocks: a prefix is named by the sum, over its turns, of a 128-bit hash of depth and id.
* A tree is given out once it holds ``HELD_BYTES`` of keys, and copies of one conversation may lie in several
  tasks. What trees say of a node are sums and minima, so partial nodes of one name are added up.
* Numbers about whole subtrees follow from sums over members. The conversations for which a node is not
  the first ride along with others from the node to where they first become the smallest member themselves
  (or to their end): the code points on that way are what the node's subtree saves. A conversation
  that is the smallest at its end, where no other goes on, is a leaf. A first run of the trees finds
  where each conversation becomes the smallest, a second adds up these two numbers.
* Nodes with a thousandth of all nodes as children (a thousand at most) are joined by broadcast, as are
  conversations with a thousandth of all parts.

The digest of the members that end at a node is one SHA-256 over their sorted ids, which is sequential by
its nature: one task streams the ids of a node from sorted rows and keeps none of them.

Defined cases: a null role or text is empty; null turns come first, turns that tie are ordered by
their id, equal ones are turns of their own; rows without a conversation are left out; a conversation all of
whose turns are replaced by none is a member of the root; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, join_with_large_keys, python_ready, quoted, text_of
from tidemark.operators.ordering import running_totals
from tidemark.session import materialize

WIDTH = 16
SPAN = 64
HELD_BYTES = 16 << 20
MOST_SHARED = 6
_WORDS = ("s0", "s1", "s2", "s3")


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Narrow rows: conv, turn, id, n_chars and a row number; written."""
    speaker, said = text_of(role), text_of(text)
    content = F.concat(F.octet_length(speaker).cast("string"), F.lit(":"), speaker, said)
    rows = df.filter(quoted(conv).isNotNull()).select(
        quoted(conv).cast("bigint").alias("conv"),
        quoted(turn).alias("turn"),
        F.unhex(F.substring(F.sha2(content, 256), 1, 2 * WIDTH)).alias("id"),
        F.length(said).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(rows, "turns")


def numbered(rows: DataFrame) -> DataFrame:
    """Turns with their position, from 1, in their conversation."""
    order = [F.col("turn").asc_nulls_first(), F.col("id").asc(), F.col("row").asc()]
    counted = running_totals(rows.withColumn("one", F.lit(1)), order, {"pos": "one"}, ["conv"])
    return counted.select("conv", "pos", "id", "n_chars")


def _shared(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % MOST_SHARED).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation, its first turns exchanged for those of the first of its hundred: conv, depth, id,
    n_chars, with a row of depth 0 for each."""
    conv = F.col("conv")
    lengths = materialize(own.groupBy("conv").agg(F.count("*").alias("n")), "conversation-lengths")
    base = (conv - conv % 100).alias("base")
    shared = _shared(conv)
    given = own.filter((conv % 100 == 0) & (F.col("pos") < MOST_SHARED)).select(
        conv.alias("base"), "pos", "id", "n_chars"
    )
    # A base serves the conversations of its hundred and gives each at most five turns.
    borrowed = lengths.select("conv", base, shared.alias("h")).join(given, "base").filter("pos <= h")
    found = lengths.filter(conv % 100 == 0).select(conv.alias("base"), F.col("n").alias("base_n"))
    missing = materialize(
        lengths.select("conv", base, "n").join(found, "base", "left").select(
            "conv", "n", (shared - F.least(shared, F.coalesce("base_n", F.lit(0)))).cast("bigint").alias("missing")
        ),
        "conversations",
    )
    total = int(lengths.agg(F.sum("n")).first()[0] or 0)
    kept = join_with_large_keys(own.filter(F.col("pos") > shared), missing, "conv", "n", total)
    roots = lengths.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(bytes(WIDTH)).alias("id"), F.lit(0).cast("bigint").alias("n_chars"))
    return (
        kept.select("conv", (F.col("pos") - F.col("missing")).alias("depth"), "id", "n_chars")
        .unionByName(borrowed.select("conv", F.col("pos").alias("depth"), "id", "n_chars"))
        .unionByName(roots)
    )


def _name(words: Sequence[Column]) -> Column:
    """Four sums as the 16 bytes that name a prefix; hexadecimal digits beyond the last eight are carries."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(w), 16, "0"), 9, 8) for w in words]))


def paths(rows: DataFrame) -> DataFrame:
    """``rebuilt`` turns with the name of the prefix that ends there, that before it, and ``upto``, the code
    points of the prefix."""
    halves = [F.xxhash64(F.lit(k), "id", "depth") for k in (1, 2)]
    words = [w for h in halves for w in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    words = {s.replace("s", "w"): F.when(F.col("depth") > 0, w).otherwise(F.lit(0)).cast("bigint") for s, w in zip(_WORDS, words)}
    sums = {s: s.replace("s", "w") for s in _WORDS} | {"upto": "n_chars"}
    added = running_totals(rows.withColumns(words), ["depth"], sums, ["conv"])
    return added.select(
        "conv", "depth", "id", "n_chars", "upto",
        _name([F.col(s) for s in _WORDS]).alias("name"),
        F.when(F.col("depth") > 0, _name([F.col(s) - F.col(s.replace("s", "w")) for s in _WORDS])).alias("parent"),
    )


def parts(steps: DataFrame) -> DataFrame:
    """Up to ``SPAN`` turns of a conversation as a row: part, context (the prefix before), key, names, upto,
    n_chars, last; written."""
    found = steps.groupBy("conv", F.expr(f"depth div {SPAN}").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "id", "name", "upto", "n_chars"))).alias("steps"),
        F.min_by("parent", "depth").alias("context"),
    )

    def joined(field: str) -> Column:
        return F.aggregate("steps", F.lit(b""), lambda a, s: F.concat(a, s[field]))

    last = F.element_at("steps", -1)
    return materialize(
        found.select(
            "conv", "part", "context", joined("id").alias("key"), joined("name").alias("names"),
            F.col("steps")["upto"].alias("upto"), F.col("steps")["n_chars"].alias("n_chars"),
            last["depth"].alias("end_depth"), last["name"].alias("end_name"), last["upto"].alias("end_upto"),
        ),
        "key-parts",
    )


_NODE = "depth bigint, name binary, parent binary, upto bigint, n_chars bigint, n bigint, conv bigint, conv_skip bigint, skip bigint, leaves bigint"


def _grow(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Trees over sorted key parts; each is given out when its prefix ends or the keys held exceed ``most`` bytes."""
    from tidemark.llm.radix import Tree

    tree, held, rows, group = Tree(), 0, [], None

    def nodes() -> Iterator[pa.RecordBatch]:
        out = []
        for depth, node in tree.aligned(WIDTH):
            part, context, names, upto, n_chars = rows[node.row]
            at = (depth - 1) * WIDTH
            parent = names[at - WIDTH : at] if at else context
            out.append(
                (part * SPAN + depth - 1, names[at : at + WIDTH], parent, upto[depth - 1], n_chars[depth - 1],
                 node.n, node.owner, node.owner_weight, node.weight, node.mark)
            )
            if len(out) == 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    for batch in batches:
        for part, context, conv, key, names, upto, n_chars, skip, leaf in zip(*(c.to_pylist() for c in batch.columns)):
            if (part, context) != group or held > most:
                yield from nodes()
                tree, rows, group = Tree(), [], (part, context)
                held = 0
            rows.append((part, context, names, upto, n_chars))
            tree.insert(key, len(rows) - 1, conv, skip, leaf)
            held += 3 * len(key) + 200
    yield from nodes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _NODE.split(", ")]
    types = [pa.binary() if c.endswith("binary") else pa.int64() for c in _NODE.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def nodes(keys: DataFrame, most: int = HELD_BYTES) -> DataFrame:
    """The trie's nodes from key parts with their numbers ``skip`` and ``leaf``; written."""
    order = ["part", "context", "key", "conv"]
    columns = ["part", "context", "conv", "key", "names", "upto", "n_chars", "skip", "leaf"]
    python_ready(keys.sparkSession)
    sorted_keys = keys.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    least = F.min(F.struct("conv", "conv_skip"))
    merged = sorted_keys.mapInArrow(lambda batches: _grow(batches, most), _NODE).groupBy("name").agg(
        *[F.max(c).alias(c) for c in ("depth", "parent", "upto", "n_chars")],
        *[F.sum(c).alias(c) for c in ("n", "skip", "leaves")],
        least.alias("first"),
    )
    return materialize(
        merged.select("*", F.col("first")["conv"].alias("conv"), F.col("first")["conv_skip"].alias("conv_skip")).drop("first"),
        "trie-nodes",
    )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, conv) to one digest per name."""
    name, digest, names, digests = None, None, [], []
    for batch in batches:
        for n, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != name:
                if digest is not None:
                    names.append(name)
                    digests.append(digest.hexdigest())
                name, digest = n, hashlib.sha256(str(conv).encode())
            else:
                digest.update(b"," + str(conv).encode())
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["name", "ends"])
        names, digests = [], []
    if digest is not None:
        yield pa.record_batch([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends"])


def trie(steps: DataFrame, most: int = HELD_BYTES) -> DataFrame:
    """One row per distinct prefix of the conversations of ``paths``: conv (the smallest member), depth,
    parent_conv, n_convs, n_children, n_leaves, saved, ends."""
    keys = parts(steps)
    plain = keys.withColumns({"skip": F.lit(0).cast("bigint"), "leaf": F.lit(0).cast("bigint")})
    found = nodes(plain, most)
    children = found.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    known = materialize(
        found.select("name", "conv", "depth", (F.col("upto") - F.col("n_chars")).alias("before")).join(children, "name", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")),
        "trie-children",
    )
    # Where a conversation becomes the smallest member, and whether it is one at a leaf.
    own = known.groupBy("conv").agg(
        F.min("before").alias("since"), (F.max_by("n_children", "depth") == 0).cast("bigint").alias("at_leaf")
    )
    whole = keys.groupBy("conv").agg(
        F.count("*").alias("n_parts"), F.max("end_upto").alias("total"), F.max_by("end_name", "end_depth").alias("end")
    )
    weights = materialize(
        whole.join(own, "conv", "left").select(
            "conv", "n_parts", "end",
            F.coalesce("since", "total").alias("skip"), F.coalesce("at_leaf", F.lit(0)).cast("bigint").alias("leaf"),
        ),
        "conversation-weights",
    )
    python_ready(steps.sparkSession)
    ended = weights.select("end", "conv").repartition("end").sortWithinPartitions("end", "conv")
    ends = ended.mapInArrow(_ends, "name binary, ends string")
    weighed = join_with_large_keys(keys, weights.drop("end"), "conv", "n_parts", keys.count())
    full = nodes(weighed, most)
    total = full.count()
    nobody = hashlib.sha256(b"").hexdigest()
    rows = full.join(known.select("name", "n_children"), "name").join(ends, "name", "left").select(
        "conv", "depth", "parent", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("skip") - F.col("conv_skip") - (F.col("n") - 1) * (F.col("upto") - F.col("n_chars"))).alias("saved"),
        F.coalesce("ends", F.lit(nobody)).alias("ends"),
    )
    rows = materialize(rows, "trie-rows")
    above = known.filter("n_children > 0").select(
        F.col("name").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n_children").alias("below")
    )
    root = rows.filter("parent IS NULL").withColumn("parent_conv", F.lit(None).cast("bigint"))
    rest = join_with_large_keys(rows.filter("parent IS NOT NULL"), above, "parent", "below", total)
    return root.unionByName(rest).drop("parent")


def op13_turn_trie(spark, folder: str) -> DataFrame:
    talks = spark.read.parquet(f"{folder}/conversations.parquet")
    return trie(paths(rebuilt(numbered(turns(talks))))).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, length(coalesce(text, '')) AS len,
         substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS pos FROM t),
k AS (SELECT DISTINCT c, c - c % 100 AS base, ({crc32_sql("c::varchar")}) % 6 AS h FROM t),
b AS (
  SELECT k.c, o.pos, o.id, o.len FROM k JOIN o ON o.c = k.base WHERE o.pos <= k.h
  UNION ALL SELECT k.c, o.pos, o.id, o.len FROM k JOIN o ON o.c = k.c WHERE o.pos > k.h
  UNION ALL SELECT c, 0, '', 0 FROM k),
p AS (
  SELECT c, len, row_number() OVER w - 1 AS depth, string_agg(id, '') OVER w AS path,
         max(pos) OVER (PARTITION BY c) = pos AS is_end FROM b WINDOW w AS (PARTITION BY c ORDER BY pos)),
n AS (
  SELECT depth, path, min(c) AS c, count(*) AS n_convs, max(len) AS len,
         sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (is_end), '')) AS ends FROM p GROUP BY depth, path),
a AS (
  SELECT n.*, up.c AS parent, (SELECT count(*) FROM n d WHERE d.depth = n.depth + 1 AND starts_with(d.path, n.path)) AS n_children
  FROM n LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = substr(n.path, 1, length(n.path) - 32)),
s AS (
  SELECT p.depth, p.path, sum((a.n_convs - 1) * a.len) AS saved, count(*) FILTER (a.n_children = 0) AS n_leaves
  FROM a JOIN p ON p.c = a.c AND p.depth <= a.depth GROUP BY p.depth, p.path)
SELECT a.c AS conv_id, a.depth, a.parent AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves,
       s.saved AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN s USING (depth, path)"""
