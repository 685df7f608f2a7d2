"""Plain versions of what operators define, row against row."""

import numpy as np

from tidepool.llm import line_dedup


def slow_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(inside)


def slow_lines(rows):
    """What line_dedup defines, line against line."""

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < line_dedup.NEAR_WORDS:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= 1

    lines = [((d, k), x.split()) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if len(x.split()) >= line_dedup.MIN_WORDS or sum(map(str.isalnum, x)) >= line_dedup.LETTERS]
    gone = {p for p, w in lines if any(q < p and near(v, w) for q, v in lines)}
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def root_of(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def slow_groups(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = [i for i, _ in rows]
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = root_of(max(ids) + 1, edges)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def slow_top(rows, queries, k):
    good = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in good:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out
