"""Plain versions of the operators, for small tables."""

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingle_set(text):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(ids, links):
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {i: root(i) for i in ids}


def near_links(sets):
    """All pairs at 0.75 or more, through an index from shingle to documents."""
    from collections import Counter, defaultdict

    holders, links = defaultdict(list), []
    for i, s in sorted(sets.items()):
        common = Counter(j for g in s for j in holders[g])
        links += [(j, i) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
        for g in s:
            holders[g].append(i)
    return links
