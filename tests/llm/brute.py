"""Plain Python versions of the contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    """(counts by kind, sha of the base spans, base spans)."""
    spans, counts = [], {}
    for no, k in enumerate(KINDS):
        counts[k] = 0
        for m in re.finditer(PATTERNS[k], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "email" or k == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or k == "card" and 14 <= len(d) <= 19 and luhn(d) or k == "phone" and 10 <= len(d) <= 15):
                counts[k] += 1
                spans.append((m.start(), no, f"{k}:{m.start()}:{m.end()}"))
    joined = ",".join(s for *_, s in sorted(spans))
    return counts, hashlib.sha256(joined.encode()).hexdigest(), joined


def shingles(text):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(ids, texts, percent=85):
    """doc_id -> smallest reachable id over all pairs."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                if a != b:
                    up[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return {ids[i]: ids[top(i)] for i in range(len(ids))}, {ids[i]: len(s) for i, s in enumerate(sets)}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, places = {}, set()
    for i in range(len(words) - 4):
        count.setdefault(tuple(words[i:i + 5]), []).append(i)
    for at in count.values():
        if len(at) > 1:
            places.update(i + j for i in at for j in range(5))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(places),
            n < 10 or 100 * len(places) > 20 * n)


def substrings(rows, window):
    """{row number: (n_words, n_removed, kept text)} of rows (doc_id, text)."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), ws in zip(rows, words):
        for j in range(len(ws) - window + 1):
            if i is not None:
                key = tuple(ws[j:j + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        for j in range(len(ws) - window + 1):
            if i is not None and least[tuple(ws[j:j + window])] < i:
                gone |= set(range(j, j + window))
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return out


def trie(rows, group=5, spread=9):
    """Nodes of rows (conv_id, turn, role, text), by walking a tree; ``spread``
    0 leaves conversations as they are."""
    import zlib
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % spread if spread else 0
        rebuilt[c] = turns.get(c - c % group, [])[:h] + own[h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p, m in members.items():
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        worth = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += worth
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             sha(c for c in m if len(rebuilt[c]) == len(p))) for p, m in members.items()]
