"""The variants of a key with an index, so that a page is compared with few of them.

Similarity is a weighted mean in which tags weigh 0.3, so that a variant at `least` or more shares at least a share of
1 - (1 - least) / 0.3 of the tags of both. Of a page's n tags it has so many that it must be in the list of one of the shortest
n - ceil(share * n) + 1 of the lists of the variants by tag; no other is compared. Pages of one shape are compared with
each variant once.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

TAG_WEIGHT = 0.3
#: Shapes that are remembered for a key; beyond it they are forgotten and compared again.
SHAPES = 20_000


def _shape(page: dict) -> tuple:
    """All that the similarity looks at, or the page's own digest of it."""
    return page.get("shape") or (
        frozenset(dict(page["tag_counts"]).items()), frozenset(r["name"] for r in page["content_regions"]), frozenset(dict(page["semantic_landmarks"])),
        page["pagination"] is None, len(page["navigation_selectors"]),
    )


class Variants:
    """`items` in order of their start, with `best` and `add`. `compared` counts the comparisons made."""

    def __init__(self, least: float, similarity: Callable[[dict, dict], float]):
        self.least, self.similarity = least, similarity
        self.share = 1 - (1 - least) / TAG_WEIGHT
        self.items: list[dict] = []
        self.lists: dict[str | None, list[int]] = {}
        self.tags: list[frozenset] = []
        self.shapes: dict[tuple, tuple[int, float, int]] = {}
        self.compared = 0

    def _tags(self, page: dict):
        return list(dict(page["tag_counts"])) or [None]  # pages without tags are alike in tags only to such pages

    def add(self, variant: dict) -> None:
        for t in self._tags(variant):
            self.lists.setdefault(t, []).append(len(self.items))
        self.items.append(variant)
        self.tags.append(frozenset(self._tags(variant)))

    def replace(self, i: int, variant: dict) -> None:
        for t in self._tags(self.items[i]):
            self.lists[t].remove(i)
        for t in self._tags(variant):
            insort(self.lists.setdefault(t, []), i)
        self.items[i], self.tags[i] = variant, frozenset(self._tags(variant))
        self.shapes.clear()

    def _candidates(self, page: dict, start: int) -> set[int]:
        """Variants from `start` on that may be alike."""
        if self.share <= TAG_WEIGHT * 1e-6:
            return set(range(start, len(self.items)))
        found = [self.lists.get(t, ()) for t in self._tags(page)]
        found.sort(key=len)
        needed = len(found) - math.ceil(self.share * len(found) - 1e-9) + 1
        some = {i for ids in found[:needed] for i in ids[bisect_left(ids, start) :]}
        mine = frozenset(self._tags(page))
        return {i for i in some if len(mine & self.tags[i]) >= self.share * len(mine | self.tags[i]) - 1e-9}

    def best(self, page: dict) -> tuple[float, int | None]:
        """The most similar variant at `least` or more (its similarity and place; ties by place), or (0, None)."""
        shape = _shape(page)
        start, same, at = self.shapes.get(shape, (0, 0.0, -1))
        for i in sorted(self._candidates(page, start)):
            s = self.similarity(self.items[i], page)
            self.compared += 1
            if s > same and s >= self.least:
                same, at = s, i
        if len(self.shapes) >= SHAPES:
            self.shapes.clear()
        self.shapes[shape] = len(self.items), same, at
        return (same, at) if at >= 0 else (0.0, None)
