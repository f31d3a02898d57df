"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = SPACED.findall(lower(text))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def components(rows):
    """{doc_id: (size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(text, items):
    """(n_words, n_hit, n_items, sha, contaminated) of one text."""
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        iw = ALNUM.findall(lower(t))
        n = min(13, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    sha = hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
    return len(w), len(hit), len(found - {None}), sha, bool(hit) and 20 * len(hit) >= len(w)
