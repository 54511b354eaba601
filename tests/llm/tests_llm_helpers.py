"""Brute-force versions of text operators."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def brute_rules(text):
    w, t = words(text), text or ""
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def brute_near(docs, threshold=85):
    sets = []
    for _, t in docs:
        w = words(low(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * min(len(a), len(b)) >= threshold * max(len(a), len(b)) and 100 * len(a & b) >= threshold * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min([x for x in (least.get(root(i)), d) if x is not None], default=None)
    return Counter((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))
