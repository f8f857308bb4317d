"""An adaptive radix tree over byte keys: inner nodes grow through four layouts, and bytes without a branch are compressed."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Few:
    """Up to `room` children, in the order of their bytes."""

    __slots__ = ("room", "keys", "children")

    def __init__(self, room: int = 4) -> None:
        self.room, self.keys, self.children = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.keys, byte)
        return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, child: Node) -> Few | Indexed | Direct:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.children[at] = child
            return self
        if len(self.keys) == self.room:
            larger = Few(16) if self.room == 4 else Indexed()
            for known, other in self.items():
                larger.put(known, other)
            return larger.put(byte, child)
        self.keys.insert(at, byte)
        self.children.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.children, strict=True)


class Indexed:
    """Up to 48 children, found by a table of 256 places."""

    __slots__ = ("place", "children")

    def __init__(self) -> None:
        self.place, self.children = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        place = self.place[byte]
        return self.children[place - 1] if place else None

    def put(self, byte: int, child: Node) -> Indexed | Direct:
        if self.place[byte]:
            self.children[self.place[byte] - 1] = child
            return self
        if len(self.children) == 48:
            larger = Direct()
            for known, other in self.items():
                larger.put(known, other)
            return larger.put(byte, child)
        self.children.append(child)
        self.place[byte] = len(self.children)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.children[place - 1]) for byte, place in enumerate(self.place) if place)


class Direct:
    """One place for each byte."""

    __slots__ = ("children",)

    def __init__(self) -> None:
        self.children: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.children[byte]

    def put(self, byte: int, child: Node) -> Direct:
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


class Node:
    """`prefix` is what follows the byte that leads here; `value` belongs to the key that ends after it, if one does."""

    __slots__ = ("prefix", "value", "below")

    def __init__(self, prefix: bytes, value: int | None = None) -> None:
        self.prefix, self.value, self.below = prefix, value, None

    def get(self, byte: int) -> Node | None:
        return self.below.get(byte) if self.below is not None else None

    def put(self, byte: int, child: Node) -> None:
        self.below = (Few() if self.below is None else self.below).put(byte, child)

    def items(self) -> Iterator[tuple[int, Node]]:
        return self.below.items() if self.below is not None else iter(())


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        node, parent, byte, at = self.root, None, 0, 0
        while True:
            if not key.startswith(node.prefix, at):
                # Part the compressed bytes where the key leaves them.
                common = _common(node.prefix, key[at : at + len(node.prefix)])
                upper = Node(node.prefix[:common])
                upper.put(node.prefix[common], node)
                node.prefix = node.prefix[common + 1 :]
                parent.put(byte, upper)
                node = upper
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            child = node.get(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            parent, byte, node, at = node, key[at], child, at + 1

    def get(self, key: bytes) -> int | None:
        node, at = self.root, 0
        while key.startswith(node.prefix, at):
            at += len(node.prefix)
            if at == len(key):
                return node.value
            node = node.get(key[at])
            if node is None:
                return None
            at += 1
        return None
