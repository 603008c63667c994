"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return text.encode().lower().decode()


def words(text):
    return WORD.findall(text or "")


def line_dedup(rows, shortest=20, least_docs=3):
    """(text, n_lines, n_dropped) of each (id, text)."""
    def key(line):
        k = low(line.strip(BLANK))
        return k if len(k) >= shortest else None

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and key(line) is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < least_docs or i == max(holders[key(x)])]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def substring_dedup(rows, size=50):
    """(text, n_words, n_removed) of each (id, text)."""
    first = {}
    for i, text in rows:
        w = words(text)
        if i is not None:
            for j in range(len(w) - size + 1):
                k = tuple(w[j : j + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


def shingles(text, size=5):
    w = words(low(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) or frozenset([tuple(w)])


def components(n, links, names):
    """Smallest name reachable from each of ``n`` places (None among them never names)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for x in range(n):
        if names[x] is not None:
            least[find(x)] = min(least.get(find(x), names[x]), names[x])
    return [least.get(find(x)) for x in range(n)]


def ngram_join(rows, size=5, percent=80):
    """(n_shingles, component) of each (id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return [(len(s), c) for s, c in zip(sets, components(len(rows), links, [i for i, _ in rows]))]
