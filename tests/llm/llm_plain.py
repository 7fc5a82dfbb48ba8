"""Plain versions that the tests compare with."""

import re
from collections import Counter, defaultdict


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def components(sets, percent=80):
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = Counter((b, a) for v in where.values() for k, a in enumerate(sorted(v)) for b in sorted(v)[:k])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def shingled(text, width):
    ws = words(text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()
