"""Brute-force versions of the operators, for small inputs."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def components(docs, words, percent):
    """{id: smallest id that links reach}; docs: (id, text)."""
    sets = [(i, shingle_set(t, words)) for i, t in docs if i is not None]
    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, s) in enumerate(sets):
        counts = {}
        for x in s:
            for j in holders[x]:
                if j < k:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(sets)}


def removed_bytes(docs, length):
    """{id: (bytes, marks)} of the rule of suffix_dedup; docs: (id, bytes)."""
    first = {}
    for i, t in docs:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(i, first.get(s, i))
    out = {}
    for i, t in docs:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out.setdefault(i, []).append((t, gone))
    return out


def spans(marks):
    out = []
    for k, m in enumerate(marks):
        if m and out and out[-1][1] == k:
            out[-1][1] = k + 1
        elif m:
            out.append([k, k + 1])
    return [tuple(x) for x in out]


def prose(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))
