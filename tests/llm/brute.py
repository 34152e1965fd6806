"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width=5):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def joined(nodes, links):
    """The smallest node that links lead to, for each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(rows, percent=80):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    root = joined({i for i, _ in sets if i is not None}, links)
    return sorted((i, len(s), root[i]) for i, s in sets if i is not None)


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> target; sources in code point order, null last; the excess is dealt out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: float(most * sizes[s]) for s in over}


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(key, source, size) rows -> sorted (key, size, source_size, target, taken)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, out, at = mix_targets(sizes, weights, share, most), [], {}
    for key, s, n in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[2])):
        middle = at.get(s, 0) + n / 2
        at[s] = at.get(s, 0) + n
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        passes = min(most, whole + (middle < target[s] - whole * sizes[s]))
        out.append((key, n, sizes[s], target[s], n * passes))
    return out
