"""Brute-force rules that several tests hold results against."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def shingle_parts(texts):
    """{id: smallest id reachable over links}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    part = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = part[a], part[b]
                    part = {k: min(x, y) if v in (x, y) else v for k, v in part.items()}
    return part


def plain_hits(text, items):
    """(words, words hit, items) of a text."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    own, hit, found, where = words(text), set(), set(), {}
    for item, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(max(1, len(w) - 9) if w else 0):
            where.setdefault(tuple(w[k : k + size]), set()).add(item)
    for size in {len(w) for w in where}:
        for p in range(len(own) - size + 1):
            names = where.get(tuple(own[p : p + size]))
            if names is not None:
                hit.update(range(p, p + size))
                found.update(str(n) for n in names if n is not None)
    return len(own), len(hit), sorted(found)
