"""Plain versions of the operators, for small inputs."""

import re
from hashlib import md5

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACES.findall(text or "")


def shingle_set(text, size):
    w = words((text or "").translate(_LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def groups(rows, size, percent):
    """[(id, text)] -> [(id, n, component)] in the order given."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        least[r] = key if r not in least else min(least[r], key)
    return [(key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows)]


def without_repeats(rows, size=13):
    """[(id, text)] -> [(id, kept text, words, removed)]"""
    first = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            t = tuple(w[i : i + size])
            first[t] = min(first.get(t, key), key)
    out = []
    for key, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key:
                gone.update(range(i, i + size))
        out.append((key, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(_LOWER))


def tiled(case, text, shortest):
    """Covered tokens of the case by the plain greedy tiling."""
    free_case, free_text, covered = [True] * len(case), [True] * len(text), 0
    while True:
        best = (shortest - 1, 0, 0)
        for p in range(len(case)):
            for t in range(len(text)):
                n = 0
                while (p + n < len(case) and t + n < len(text) and case[p + n] == text[t + n]
                       and free_case[p + n] and free_text[t + n]):
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < shortest:
            return covered
        for k in range(n):
            free_case[p + k] = free_text[t + k] = False
        covered += n


def targets(sizes, weights=(1, 2, 3), most=3):
    """{domain: words} -> {domain: target}, excess shared anew until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate >= most * sizes[s]}
        if not full:
            return out | {s: weight[s] * rate for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= full
    return out


def copies(key, rate, seed="mix-1"):
    chance = int(md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:12], 16) / 2**48
    return int(rate) + (chance < rate - int(rate))


PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)


def base_spans(text):
    found = []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(found))
