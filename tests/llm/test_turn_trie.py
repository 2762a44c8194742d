import os
import random
from collections import Counter

import pytest

from tests.llm import brute
from tidemark.llm import turn_trie as t
from tidemark.llm.radix import Direct, Index, Node, Row, Tree

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, name string"


def found(spark, rows, most=t.HELD_BYTES, parts=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    result = t.trie(t.paths(t.rebuilt(t.numbered(t.turns(df)))), most).select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"
    )
    return sorted((tuple(r) for r in result.collect()), key=repr)


def talks(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = rng.choice([c, c + 300, -c, 10_000 + 100 * c])
        for k in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "", None])
            rows.append((conv, rng.choice([k, k, k, None, 2]), role, rng.choice(["hello", "ok", "", None, "é漢", f"{rng.random()}"])))
    return rows


def test_against_brute_force(spark):
    rows = talks(1)
    rows += [(None, 1, "user", "nobody"), (7, 3, "user", "again"), (7, 3, "user", "again")]
    assert found(spark, rows) == sorted(brute.trie(rows), key=repr)


def test_long_conversations_and_copies(spark):
    """A conversation with a third of all turns, copies of one, a common start, keys that end inside others."""
    long = [("user" if k % 2 else "assistant", f"line {k % 50}") for k in range(300)]
    rows = [(100 * c, k, *turn) for c in (1, 2, 3) for k, turn in enumerate(long[: 300 - 40 * (c - 1)])]
    rows += [(1000 + 100 * c, k, *turn) for c in range(150) for k, turn in enumerate(long[:3])]
    rows += [(50_000 + c, k, *turn) for c in range(100) for k, turn in enumerate(long[: c % 8])]
    wanted = sorted(brute.trie(rows), key=repr)
    assert found(spark, rows) == wanted
    # Trees given out after a few keys, on other partitions: the same sums.
    assert found(spark, rows, most=2000, parts=3) == wanted


def test_turnless_and_empty(spark):
    # 1305's five first turns are those of 1300, which is absent; it has fewer of its own.
    turnless = next(c for c in range(1301, 1400) if brute.zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(turnless, 0, "user", "a"), (turnless, 1, "user", "b")]
    assert found(spark, rows) == [(turnless, 0, None, 1, 0, 1, 0, brute.sha(str(turnless)))]
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "a")]) == []


def test_turn_contents_are_not_confused(spark):
    """Role and text that run together alike stay different turns."""
    h0 = [c for c in range(0, 20_000, 100) if brute.zlib.crc32(str(c).encode()) % 6 == 0][:2]
    rows = [(h0[0], 0, "user", "ab"), (h0[1], 0, "usera", "b")]
    assert len(found(spark, rows)) == 3


def test_tree_layouts_and_paths():
    rng = random.Random(3)
    for width, alphabet in [(1, 256), (2, 60), (4, 3), (4, 256)]:
        keys = [b"".join(bytes(rng.randrange(alphabet) for _ in range(width)) for _ in range(rng.randint(0, 4))) for _ in range(800)]
        tree = Tree()
        for i, key in enumerate(keys):
            tree.insert(key, i, owner=1000 - i, weight=i, mark=1)
        seen = {}
        for depth, node in tree.aligned(width):
            prefix = keys[node.row][: depth * width]
            assert prefix not in seen
            members = [i for i, k in enumerate(keys) if len(k) >= depth * width and k[: depth * width] == prefix]
            assert (node.n, node.mark, node.weight) == (len(members), len(members), sum(members))
            assert (node.owner, node.owner_weight) == (1000 - max(members), max(members))
            seen[prefix] = node
        assert set(seen) == {k[: d * width] for k in keys for d in range(1, len(k) // width + 1)}


def test_layouts_grow():
    layout, kinds = Row(), []
    for byte in random.Random(5).sample(range(256), 256):
        layout = layout.put(byte, Node(bytes([byte]), byte))
        kinds.append((type(layout).__name__, getattr(layout, "room", None)))
        assert layout.find(byte).row == byte
    assert Counter(kinds) == {("Row", 4): 4, ("Row", 16): 12, ("Index", None): 32, ("Direct", None): 208}
    assert [b for b, _ in layout.items()] == list(range(256))
    replaced = Node(b"", -1)
    for kind in (Row(), Index(), Direct()):
        kind = kind.put(9, Node(b"", 0)).put(9, replaced)
        assert kind.find(9) is replaced and kind.find(8) is None and len(list(kind.items())) == 1


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_names_do_not_collide_on_the_test_data(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    steps = t.paths(t.rebuilt(t.numbered(t.turns(talks))))
    assert steps.select("name").distinct().count() == len(brute.trie([tuple(r) for r in talks.collect()]))
