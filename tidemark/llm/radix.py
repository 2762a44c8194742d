"""An adaptive radix tree over byte keys: the in-task part of the conversation trie.

A node holds the bytes that all keys below it share (path compression) and its children in one of four
layouts that grow with their number: up to 4 and up to 16 children as a sorted row of bytes, up to 48
behind an index of 256 bytes, else one slot for every byte. Every key carries numbers that are added up at
the nodes it passes. Keys may be prefixes of others and may repeat.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Row:
    """Children by sorted byte: layouts of 4 and 16."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4):
        self.keys, self.nodes, self.room = bytearray(), [], room

    def find(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node: Node):
        """The layout to use from now on: this one, or the next larger if it was full."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            larger = Row(16) if self.room == 4 else Index()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self):
        return zip(self.keys, self.nodes)


class Index:
    """Up to 48 children behind an index by byte."""

    __slots__ = ("slots", "nodes")
    ROOM = 48

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def find(self, byte: int):
        slot = self.slots[byte]
        return self.nodes[slot - 1] if slot else None

    def put(self, byte: int, node: Node):
        if slot := self.slots[byte]:
            self.nodes[slot - 1] = node
            return self
        if len(self.nodes) == self.ROOM:
            larger = Direct()
            for b, n in self.items():
                larger.put(b, n)
            return larger.put(byte, node)
        self.nodes.append(node)
        self.slots[byte] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[slot - 1]) for b, slot in enumerate(self.slots) if slot)


class Direct:
    """A slot for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def find(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node: Node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """``shared`` bytes, children, and over the keys below: how many, the least owner and that owner's
    first weight, the sums of both weights, and one key's row."""

    __slots__ = ("shared", "kids", "n", "owner", "owner_weight", "weight", "mark", "row")

    def __init__(self, shared: bytes, row: int):
        self.shared, self.row, self.kids = shared, row, None
        self.n = self.weight = self.mark = 0
        self.owner = self.owner_weight = None

    def add(self, owner: int, weight: int, mark: int) -> None:
        self.n += 1
        self.weight += weight
        self.mark += mark
        if self.owner is None or owner < self.owner:
            self.owner, self.owner_weight = owner, weight

    def above(self, length: int) -> Node:
        """Split off the first ``length`` shared bytes: a new parent with this node as its only child."""
        parent = Node(self.shared[:length], self.row)
        parent.n, parent.weight, parent.mark = self.n, self.weight, self.mark
        parent.owner, parent.owner_weight = self.owner, self.owner_weight
        parent.kids = Row().put(self.shared[length], self)
        self.shared = self.shared[length + 1 :]
        return parent


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Tree:
    def __init__(self):
        self.root = None

    def insert(self, key: bytes, row: int, owner: int, weight: int, mark: int) -> None:
        """Add a key. ``row`` names it to the caller, who asks for one key below every node."""
        at, parent, byte, node = 0, None, 0, self.root
        while node is not None:
            shared = node.shared
            same = _common(shared, key[at : at + len(shared)])
            if same < len(shared):
                node = node.above(same)
                self._attach(parent, byte, node)
            node.add(owner, weight, mark)
            at += same
            if at == len(key):
                return
            parent, byte = node, key[at]
            node = None if parent.kids is None else parent.kids.find(byte)
            at += 1
        leaf = Node(key[at:], row)
        leaf.add(owner, weight, mark)
        self._attach(parent, byte, leaf)

    def _attach(self, parent: Node | None, byte: int, node: Node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.kids = (parent.kids or Row()).put(byte, node)

    def aligned(self, width: int) -> Iterator[tuple[int, Node]]:
        """Every byte depth that is a multiple of ``width``, counted in widths, with the node that spans it."""
        stack = [] if self.root is None else [(0, self.root)]
        while stack:
            start, node = stack.pop()
            end = start + len(node.shared)
            # The byte that leads here was counted by ``start``; the empty key itself is no depth.
            first = max(-(-start // width), 1)
            for depth in range(first, end // width + 1):
                yield depth, node
            if node.kids is not None:
                stack.extend((end + 1, kid) for _, kid in node.kids.items())
