"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def decontaminated(documents, benchmark, window=8):
    items = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            items[tuple(w[i : i + window])].add(item)
    sizes = {len(k) for k in items}
    out = {}
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in items:
                    hit |= set(range(i, i + n))
                    found |= items[k]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1) if w else 0))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(documents, threshold=0.8):
    """doc -> least id of its class, by comparing every pair that shares a shingle."""
    root = {d: d for d, _ in documents}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(x, y):
        x, y = sorted((find(x), find(y)))
        root[y] = x

    exact, where, bags = {}, defaultdict(list), {}
    for d, t in documents:
        if t is None:
            continue
        key = tuple(words(t)) or ("", t)
        if key in exact:
            join(d, exact[key])
            continue
        exact[key] = d
        bags[d] = bag(t)
        for s in bags[d]:
            where[s].append(d)
    for d, b in bags.items():
        for o in {o for s in b for o in where[s] if o < d}:
            if find(o) != find(d) and sum(b.values()) and jaccard(b, bags[o]) >= threshold:
                join(d, o)
    return {d: find(d) for d, _ in documents}


def personal(text):
    """Base spans of a text by kind, straight from the patterns."""
    text = text or ""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(s):
        return "".join(c for c in s if c in "0123456789")

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}


def grams(texts):
    """Counts of byte 4-grams of lower-case ASCII texts."""
    out = Counter()
    for t in texts:
        b = t.encode()
        out.update(b[i : i + 4] for i in range(len(b) - 3))
    return out
