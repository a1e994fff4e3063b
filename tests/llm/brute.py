"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def near(docs, percent=85):
    """[(doc_id, n_shingles, component_id, kept)] per row; rows of one id are one document."""
    sets, of = [], {}
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
        of.setdefault(sets[-1][1], []).append(d)
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    some = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(some):
        for b, t in some[i + 1 :]:
            if (both := len(s & t)) and 100 * both >= percent * len(s | t):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    comp = lambda d, s: root(d) if s and d is not None else d
    return sorted(((d, len(s), comp(d, s), comp(d, s) == d) for d, s in sets), key=str)


def without_repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)} for rows in the order of their ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def decontaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        ids = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit))
    return out
