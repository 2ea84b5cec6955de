"""A compressed radix (Patricia) trie of byte strings that spills by subtree."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

from shardloom.llm.common import id_order


class _Node:
    __slots__ = ("count", "edge", "file", "kids", "load", "owner", "tag")

    def __init__(self, edge: bytes):
        self.edge, self.kids = edge, None
        self.owner = self.tag = self.file = None
        self.count = self.load = 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixOwners:
    """Terminal nodes hold the smallest identifier, the number of insertions and the owner's tag.

    limit: bytes of strings and tags held in memory. Beyond it the heaviest
    subtree below the first branching node goes to a temporary file, and later
    insertions that reach it are appended there. rows() reads each file into a
    trie of its own, which branches deeper, so the recursion ends.
    """

    def __init__(self, limit: int = 64 << 20):
        self.limit, self.held, self.root = limit, 0, _Node(b"")
        self.spills = 0

    def insert(self, key: bytes, owner, count: int = 1, tag: bytes = b"") -> None:
        node, at, path = self.root, 0, []
        while True:
            path.append(node)
            if node.file is not None:
                pickle.dump((key[at:], owner, count, tag), node.file, protocol=5)
                return
            if at == len(key):
                break
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                kid = _Node(key[at:])
                if node.kids is None:
                    node.kids = {}
                node.kids[key[at]] = kid
                at = len(key)
            elif key.startswith(kid.edge, at):
                at += len(kid.edge)
            else:
                same = _common(kid.edge, key[at : at + len(kid.edge)])
                upper = _Node(kid.edge[:same])
                upper.load = kid.load
                kid.edge = kid.edge[same:]
                upper.kids = {kid.edge[0]: kid}
                node.kids[key[at]] = upper
                kid = upper
                at += same
            node = kid
        gain = 0
        if not node.count:
            gain = len(key) + len(tag) + 200
            node.owner, node.tag = owner, tag
        elif id_order(owner) < id_order(node.owner):
            gain = len(tag) - len(node.tag)
            node.owner, node.tag = owner, tag
        node.count += count
        for x in path:
            x.load += gain
        self.held += gain
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        node, above = self.root, [self.root]
        while node.kids and len(node.kids) == 1 and not node.count:
            below = next(iter(node.kids.values()))
            if below.file is not None:
                return
            node = below
            above.append(node)
        kids = [x for x in (node.kids or {}).values() if x.file is None]
        if not kids:
            return
        worst = max(kids, key=lambda x: x.load)
        file = tempfile.TemporaryFile()  # noqa: SIM115  closed by rows()
        stack = [(worst, b"")]
        while stack:
            x, prefix = stack.pop()
            if x.count:
                pickle.dump((prefix, x.owner, x.count, x.tag), file, protocol=5)
            if x.file is not None:
                x.file.seek(0)
                for rest, *found in _records(x.file):
                    pickle.dump((prefix + rest, *found), file, protocol=5)
                x.file.close()
            stack += [(y, prefix + y.edge) for y in (x.kids or {}).values()]
        worst.file, worst.kids, worst.count, worst.owner, worst.tag = file, None, 0, None, None
        for x in above:
            x.load -= worst.load
        self.held -= worst.load
        worst.load = 0
        self.spills += 1

    def rows(self) -> Iterator[tuple]:
        """(owner, count, tag) of each distinct string; the trie is used up."""
        stack = [self.root]
        while stack:
            x = stack.pop()
            if x.file is not None:
                x.file.seek(0)
                below = RadixOwners(self.limit)
                for key, owner, count, tag in _records(x.file):
                    below.insert(key, owner, count, tag)
                x.file.close()
                yield from below.rows()
            elif x.count:
                yield x.owner, x.count, x.tag
            stack += (x.kids or {}).values()
            x.kids = None


def _records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return
