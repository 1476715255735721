"""All pairs by brute force."""

from itertools import combinations


def linked(texts: dict, k: int, percent: int) -> list:
    """The least id of each component of the texts."""
    sets = {}
    for d, t in texts.items():
        w = t.lower().encode().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(d for d in texts if root[d] == d)
