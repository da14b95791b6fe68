"""BK-trees over bit strings, for the links of near-equal fingerprints.

Children hang under their integer Hamming distance to the parent. By the
triangle inequality a node within ``radius`` of a query can only lie under an
edge within ``radius`` of the query's own distance to the parent, so only those
edges are followed.

Only connectivity is asked for, so a node also remembers whether all of its
subtree is in one component; a subtree that the query already belongs to is
skipped. A dense group then costs a few visits an insertion instead of one for
each member, and no pairs within it are listed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


class BKForest:
    """A BK-tree with the components of its members under a radius."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        #: A member of the only component in the subtree, or -1.
        self.only: list[int] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, value: int, accept: Callable[[int], bool] | None = None, beside: int | None = None) -> list[int]:
        """Inserts a value; members that it links to a component of its own.

        One member for each component that lay within the radius: with the links
        of earlier insertions they connect all that is connected. Of the members
        within the radius only those that ``accept`` confirms are linked.
        ``beside`` is a member that the value is known to be connected with.
        """
        new, radius, values, children, only = len(self.values), self.radius, self.values, self.children, self.only
        self.parent.append(new if beside is None else self.find(beside))
        links: list[int] = []
        stack = [0] if new else []
        while stack:
            i = stack.pop()
            if only[i] >= 0 and self.find(only[i]) == self.find(new):
                continue
            distance = (values[i] ^ value).bit_count()
            if distance <= radius and (root := self.find(i)) != (own := self.find(new)) and (accept is None or accept(i)):
                self.parent[own] = root
                links.append(i)
            stack += [c for d, c in children[i].items() if -radius <= d - distance <= radius]
        values.append(value)
        children.append({})
        only.append(new)
        i = 0
        while i != new:
            if only[i] >= 0 and self.find(only[i]) != self.find(new):
                only[i] = -1
            distance = (values[i] ^ value).bit_count()
            if distance not in children[i]:
                children[i][distance] = new
                break
            i = children[i][distance]
        return links

    def within(self, value: int) -> list[int]:
        """All members within the radius of a value."""
        found, stack = [], [0] if self.values else []
        while stack:
            i = stack.pop()
            distance = (self.values[i] ^ value).bit_count()
            if distance <= self.radius:
                found.append(i)
            stack += [c for d, c in self.children[i].items() if -self.radius <= d - distance <= self.radius]
        return found


def spanning_links(values: Sequence[int], radius: int) -> list[tuple[int, int]]:
    """Index pairs within ``radius`` whose components are those of all such pairs."""
    tree = BKForest(radius)
    return [(j, i) for i, value in enumerate(values) for j in tree.add(value)]
