"""Plain versions of what the operators work out, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_list(text, n):
    ws = words(text)
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [tuple(ws)] if ws else []


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def linked(rows, n, num, den):
    """doc_id -> (set size, component) of (doc_id, text) rows with distinct ids."""
    sets = {d: frozenset(shingle_list(t, n)) for d, t in rows}
    ids = sorted(d for d in sets if sets[d])
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                common = len(x & y)
                if den * common >= num * (len(x) + len(y) - common):
                    links.append((a, b))
    roots = components(sets, links)
    return {d: (len(s), roots[d]) for d, s in sets.items()}
