"""Plain versions of the operators, for small tables only."""

from __future__ import annotations

import re


def word_sets(texts, width):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not words:
            out.append(frozenset())
        else:
            out.append(frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))))
    return out


def jaccard_components(rows, width, percent):
    """rows: (id, text) -> {id: (size, component)}"""
    sets = word_sets([t for _, t in rows], width)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for token in s:
            holders.setdefault(token, []).append(i)
    pairs = {}
    for members in holders.values():
        for x, i in enumerate(members):
            for j in members[:x]:
                pairs[j, i] = pairs.get((j, i), 0) + 1
    for (i, j), common in pairs.items():
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}
