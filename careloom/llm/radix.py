"""An adaptive radix tree over byte strings, inside one task.

A node's children are held in the smallest of four layouts that fits them, and a node with one child
and no value of its own is folded into the bytes of its edge.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: Children that the layouts hold: sorted bytes, sorted bytes, an index of 256 bytes, a slot per byte.
LAYOUTS = (4, 16, 48, 256)


class Node:
    """The bytes below its branch byte, a value (-1: none) and its children."""

    __slots__ = ("prefix", "value", "room", "index", "slots")

    def __init__(self, prefix: bytes, value: int = -1):
        self.prefix, self.value = prefix, value
        self.room = LAYOUTS[0]
        self.index = bytearray()
        self.slots: list = []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = bisect_left(self.index, byte)
            return self.slots[at] if at < len(self.index) and self.index[at] == byte else None
        if self.room == 48:
            at = self.index[byte]
            return self.slots[at - 1] if at else None
        return self.slots[byte]

    def add(self, byte: int, node: Node) -> None:
        """Enters a child under a new byte, in the next layout if this one is full."""
        if self.room <= 48 and len(self.slots) == self.room:
            self.grow()
        if self.room <= 16:
            at = bisect_left(self.index, byte)
            self.index.insert(at, byte)
            self.slots.insert(at, node)
        elif self.room == 48:
            self.slots.append(node)
            self.index[byte] = len(self.slots)
        else:
            self.slots[byte] = node

    def grow(self) -> None:
        pairs = list(self.children())
        self.room = LAYOUTS[LAYOUTS.index(self.room) + 1]
        if self.room == 48:
            self.index = bytearray(256)
            self.slots = [n for _, n in pairs]
            for i, (byte, _) in enumerate(pairs, 1):
                self.index[byte] = i
        elif self.room == 256:
            self.index = bytearray()
            self.slots = [None] * 256
            for byte, node in pairs:
                self.slots[byte] = node

    def children(self) -> Iterator[tuple[int, Node]]:
        """Children in the order of their bytes."""
        if self.room <= 16:
            yield from zip(self.index, self.slots, strict=True)
        elif self.room == 48:
            yield from ((b, self.slots[at - 1]) for b, at in enumerate(self.index) if at)
        else:
            yield from ((b, n) for b, n in enumerate(self.slots) if n is not None)

    def split(self, at: int) -> None:
        """Keeps ``at`` bytes of the prefix and moves everything else to one child."""
        lower = Node(self.prefix[at + 1:], self.value)
        lower.room, lower.index, lower.slots = self.room, self.index, self.slots
        byte = self.prefix[at]
        self.prefix, self.value = self.prefix[:at], -1
        self.room, self.index, self.slots = LAYOUTS[0], bytearray(), []
        self.add(byte, lower)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value: int) -> None:
        """Enters a key; a key may be the beginning of another one. Entering it again replaces its value."""
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            if not key.startswith(node.prefix, at):
                node.split(common(node.prefix, key[at: at + len(node.prefix)]))
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.add(key[at], Node(key[at + 1:], value))
                return
            node, at = below, at + 1

    def bottom_up(self) -> Iterator[tuple[Node, int, int, int]]:
        """(node, start of its edge, end of its edge, number of its children), children first and in order.

        An edge begins behind its start; the root's starts before the first byte, at -1.
        """
        if self.root is None:
            return
        stack = [(self.root, -1, len(self.root.prefix), iter(self.root.children()), 0)]
        while stack:
            node, start, end, rest, seen = stack.pop()
            step = next(rest, None)
            if step is None:
                yield node, start, end, seen
                continue
            below = step[1]
            stack.append((node, start, end, rest, seen + 1))
            stack.append((below, end, end + 1 + len(below.prefix), iter(below.children()), 0))
