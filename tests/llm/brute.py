"""Plain versions of the operators, for small tables."""

import re


def shingle_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def linked(sets, percent):
    """Pairs of positions whose sets are similar enough, by an inverted index."""
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    out = set()
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in at[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        out |= {(i, j) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    return out


def smallest(ids, pairs):
    """Each position's smallest reachable id."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
        root[b] = a
    return [ids[find(i)] for i in range(len(ids))]
