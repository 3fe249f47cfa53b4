"""Plain-Python models of the operators, used only by tests."""

from __future__ import annotations

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def repeats(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest); ids unique."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text: str | None, size: int = 3) -> frozenset:
    w = WORD.findall(lower_az(text or ""))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_components(docs, size: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable by links)."""
    sets = {d: shingle_set(t, size) for d, t in docs}
    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    from collections import Counter

    for d, s in sets.items():
        hits = Counter(o for x in s for o in by[x] if o < d)
        for o, k in hits.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def text_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at: dict = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def trie(rows, group: int = 20, heads: int = 4) -> set[tuple]:
    """Rows (conv_id, turn, role, text), turn numbers unique in a conversation -> the nodes of the rebuilt conversations."""
    import zlib

    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + v[h:]
    members: dict = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    if not built:
        return set()
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, below = set(), {}
    for p in sorted(members, key=len, reverse=True):
        m, kids = members[p], children.get(p, [])
        words = len(WORD.findall(p[-1][1])) if p else 0
        leaves = sum(below[k][0] for k in kids) or 1
        saved = (len(m) - 1) * words + sum(below[k][1] for k in kids)
        below[p] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
