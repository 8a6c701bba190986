"""Plain models of the operators, over small lists of (doc_id, text)."""

import collections
import hashlib
import re
import zlib

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def shingles(text, n=5, short=True):
    w = words(text)
    if short and 0 < len(w) < n:
        return {tuple(w)}
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def exact_groups(rows):
    plain = lambda t: (t or "").translate({ord(c): None for c in SPACES})
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[plain(t)].append((-len(t or ""), d is None, d if d is not None else 0, d))
    return {k: (sorted(g)[0][3], len(g)) for k, g in groups.items()}, plain


def removed(rows, n=20):
    """Of each row of unique id, which words go."""
    first = {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), (d, i))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def near_classes(rows, t=0.8):
    """(class, links) of each row of unique id."""
    sets = {d: shingles(x) for d, x in rows}
    inside = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inside[x].append(d)
    common = collections.Counter()
    for ds in inside.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[min(a, b), max(a, b)] += 1
    root = {d: d for d in sets}
    links = collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if c >= t * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d in sets}


def contained(rows, items, t=0.8):
    out = set()
    for i, x in items:
        n = min(5, len(words(x)))
        want = shingles(x, n) if n else set()
        for d, y in rows:
            if want and len(want & shingles(y, n, short=False)) >= t * len(want):
                out.add((d, i))
    return out


def unit_scores(rows):
    """(tokens, known, base score) of each row of unique id, and the training tokens."""
    import math

    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    count = collections.Counter()
    for d in tokens:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(tokens[d])
    n, v = sum(count.values()), len(count)
    return {d: (len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in tokens.items()}, n


def best_fit(lengths, capacity):
    """Bins and their rooms by best fit of one piece at a time, longest first."""
    import bisect

    rooms = []
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms), rooms
