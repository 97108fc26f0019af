"""Plain versions of what the operators compute, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter


def groups(pairs, nodes):
    """Each node's smallest reachable node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def near_copies(rows, words, similarity=80):
    """doc_id to (set size, component) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, words) for i, t in rows}
    holders: dict[tuple, list] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    pairs = [p for p, n in common.items() if 100 * n >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = groups(pairs, sets)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def base_spans(text):
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def viterbi(text, pieces, unknown):
    """Best score of any segmentation, trying every piece at every place."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[text[start:end]])
        if text[end - 1] not in pieces:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]
