"""Plain forms of the operators, on lists of rows."""

import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_set(words, n):
    if len(words) >= n:
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def classes(rows, n, num, den):
    """``{id: (set size, smallest id reachable)}``."""
    sets = {i: shingle_set(spaced(t), n) for i, t in rows}
    parent, holders = {i: i for i in sets}, defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        for j, c in shared.items():
            if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def lines_kept(rows, n=5, num=80, den=100):
    """``{id: text}`` without later matches of lines."""
    seen, sets, holders, out = {}, [], defaultdict(list), {}
    for i, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            own = shingle_set(spaced(line), n)
            if not own:
                left.append(line)
                continue
            if own in seen:
                continue
            shared = Counter(j for g in own for j in holders[g])
            gone = any(den * c >= num * (len(own) + len(sets[j]) - c) for j, c in shared.items())
            seen[own] = len(sets)
            sets.append(own)
            for g in own:
                holders[g].append(seen[own])
            if not gone:
                left.append(line)
        out[i] = "\n".join(left)
    return out


def hits(docs, items, window=10):
    """``{id: (words, hit words, items)}``."""
    windows = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs:
        words, hit, found = alnum(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if gram := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= gram
        out[i] = (len(words), len(hit), sorted(found))
    return out


def repeats_cut(rows, width):
    """``{id: (bytes, removed, runs, kept)}``."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - width + 1):
            piece = raw[k : k + width]
            if piece in seen:
                gone[k : k + width] = [True] * width
            seen.add(piece)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def collocations(rows, least, top, longest=5):
    """Sorted ``(lang, rank, phrase, a, l, r, n, score)`` of rows ``(lang, text)``."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        held = set()
        for phrase, c in count.items():
            words = phrase.split(" ")
            if len(words) > 2 and c >= least:
                parts = {" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 2, len(words) + 1)}
                held |= {p for p in parts - {phrase} if 100 * c >= 100 * count[p]}
        scored = []
        for phrase, a in count.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < least or phrase in held:
                continue
            sides = [(count[" ".join(words[:k])], count[" ".join(words[k:])]) for k in range(1, len(words))]
            score, k = min((1000 * a * total[lang] // (l * r), k) for k, (l, r) in enumerate(sides))
            scored.append((-score, -a, phrase.encode(), phrase, a, *sides[k], total[lang], score))
        out += [(lang, i + 1, *x[3:]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(out)
