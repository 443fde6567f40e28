"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOW))


def runs(text: str | None, width: int = 5) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i: i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] * bool(w)


def similar_groups(sets: dict, percent: int) -> dict:
    """Least key of each key's component under Jaccard links; empty sets link with nothing."""
    parent, common, holders = {k: k for k in sets}, Counter(), defaultdict(list)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}


def leaks(docs: dict, items: dict, percent: int = 75) -> dict:
    """(doc, item) -> best weighted similarity of an item-sized window."""
    out = {}
    for i, item in items.items():
        want, n = Counter(runs(item)), len(words(item))
        for d, text in docs.items():
            w = words(text)
            best = 0.0
            for a in range(len(w) - n + 1) if n else ():
                have = Counter(runs(" ".join(w[a: a + n])))
                both = sum((have & want).values())
                best = max(best, both / (sum(have.values()) + sum(want.values()) - both))
            if 100 * best >= percent:
                out[d, i] = best
    return out
