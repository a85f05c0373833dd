"""Plain versions of the operators, by definition and for small tables."""

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def lines(rows, k=2, long_words=50):
    """{id: (n_lines, n_removed, n_runs, kept)} of [(id, text)]"""
    texts = {i: (t or "").split("\n") for i, t in sorted(rows)}
    seen, gone = set(), {i: set() for i in texts}
    for i, ls in texts.items():
        for p in range(len(ls)):
            for n in {k, 1}:
                w = tuple(ls[p : p + n])
                if len(w) < n or n < k and len(SPACE_WORD.findall(w[0])) < long_words:
                    continue
                if w in seen:
                    gone[i].update(range(p, p + n))
                seen.add(w)
    return {i: (len(ls), len(gone[i]), sum(p in gone[i] and p - 1 not in gone[i] for p in range(len(ls))), "\n".join(x for p, x in enumerate(ls) if p not in gone[i])) for i, ls in texts.items()}


def suffixes(rows):
    """[(id, line)] of the suffixes of lines that occur twice or more, in order, and what each shares with the one before.

    rows: [(id, [symbol])]. A symbol that occurs once, or a row's end, sorts before all symbols and by its place.
    """
    times = Counter(x for _, ls in rows for x in ls)
    order = {x: k for k, x in enumerate(sorted(x for x in times if times[x] > 1))}
    keys = {}
    for i, ls in rows:
        own = [(1, order[x], 0) if x in order else (0, i, p) for p, x in enumerate(ls)] + [(0, i, len(ls))]
        for p, x in enumerate(ls):
            if x in order:
                stop = next(q for q in range(p, len(own)) if own[q][0] == 0)
                keys[i, p] = [*own[p:stop], (0, i, p)]
    out = sorted(keys, key=keys.get)
    shared = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
    return out, [0, *[shared(keys[a], keys[b]) for a, b in zip(out, out[1:], strict=False)]]


def shingles(text, k=5):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def substrings(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - window + 1):
            g = b[p : p + window]
            if g in seen:
                hit[p : p + window] = b"\1" * window
            seen.add(g)
        spans = sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1]))
        out[i] = (len(b), sum(hit), spans, bytes(c for c, h in zip(b, hit, strict=True) if not h))
    return out


def contamination(docs, items, window=8):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        m = min(len(w), window)
        for p in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + m]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, met = set(), set()
        for m in {len(x) for x in wins}:
            for p in range(len(w) - m + 1):
                if found := wins.get(tuple(w[p : p + m])):
                    hit.update(range(p, p + m))
                    met |= found
        out[d] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(met) >= 2)
    return out


def pii(text):
    out, text = [], text or ""

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def quality_counts(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    with_word = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(with_word) - len(set(with_word)), len(repeated)


def license_base(text, phrases):
    w = WORD.findall(lower(text))
    found = [(p, label) for phrase, label in phrases for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
