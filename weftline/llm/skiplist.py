"""An indexable skip list of values with counts: a sliding multiset whose rank look-ups walk the spans of its links."""

from __future__ import annotations

HEIGHT = 24


def _height(value: int) -> int:
    """One more than the trailing zeros of a hash of the value, so that a rerun builds the same list."""
    h = (value * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 32
    return min(HEIGHT, (h & -h).bit_length()) if h else HEIGHT


class _Node:
    __slots__ = ("after", "count", "span", "value")

    def __init__(self, value: int | None, count: int, height: int):
        self.value, self.count = value, count
        self.after: list[_Node | None] = [None] * height
        #: Items from behind this node up to and with the node that the link leads to (or up to the end).
        self.span = [0] * height


class SkipList:
    """Values ascending, equal values in one node; memory follows the distinct values, not the items."""

    def __init__(self) -> None:
        self._head = _Node(None, 0, 1)
        self.size = 0

    def _path(self, value: int) -> tuple[list[_Node], list[int]]:
        """On each level the last node below the value, and the items up to and with it."""
        node, at = self._head, 0
        top = len(node.after)
        nodes, ranks = [node] * top, [0] * top
        for level in range(top - 1, -1, -1):
            nxt = node.after[level]
            while nxt is not None and nxt.value < value:
                at += node.span[level]
                node = nxt
                nxt = node.after[level]
            nodes[level], ranks[level] = node, at
        return nodes, ranks

    def add(self, value: int, count: int = 1) -> None:
        nodes, ranks = self._path(value)
        self.size += count
        here = nodes[0].after[0]
        if here is not None and here.value == value:
            here.count += count
            for level, node in enumerate(nodes):
                node.span[level] += count
            return
        height = _height(value)
        for _ in range(len(nodes), height):
            self._head.after.append(None)
            self._head.span.append(self.size - count)
            nodes.append(self._head)
            ranks.append(0)
        here = _Node(value, count, height)
        before = ranks[0]
        for level, node in enumerate(nodes):
            if level < height:
                skipped = before - ranks[level]
                here.after[level], here.span[level] = node.after[level], node.span[level] - skipped
                node.after[level], node.span[level] = here, skipped + count
            else:
                node.span[level] += count

    def remove(self, value: int, count: int = 1) -> None:
        nodes, _ = self._path(value)
        here = nodes[0].after[0]
        if here is None or here.value != value or here.count < count:
            raise KeyError(value)
        self.size -= count
        here.count -= count
        gone, height = here.count == 0, len(here.after)
        for level, node in enumerate(nodes):
            node.span[level] -= count
            if gone and level < height:
                node.span[level] += here.span[level]
                node.after[level] = here.after[level]

    def at(self, rank: int) -> int:
        """The value of the item with this rank, counted from 1."""
        if not 1 <= rank <= self.size:
            raise IndexError(rank)
        node = self._head
        for level in range(len(node.after) - 1, -1, -1):
            while node.after[level] is not None and node.span[level] < rank:
                rank -= node.span[level]
                node = node.after[level]
        return node.after[0].value
