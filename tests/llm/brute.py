"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def base_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def substring_dedup(rows, n=50):
    """(doc_id, text) rows -> Counter of (doc_id, n_words, n_removed, kept_sha256)"""
    first = {}
    for doc, text in rows:
        words = SPACE.findall(text or "")
        for i in range(len(words) - n + 1) if doc is not None else ():
            key = tuple(words[i : i + n])
            first[key] = min(first.get(key, doc), doc)
    out = Counter()
    for doc, text in rows:
        words = SPACE.findall(text or "")
        gone = {i + k for i in range(len(words) - n + 1) if doc is not None and first[tuple(words[i : i + n])] < doc for k in range(n)}
        out[doc, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    return out


def suffix_dedup(rows, n=400):
    data = [(text or "").encode() for _, text in rows]
    count = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = Counter()
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out[doc, len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))] += 1
    return out


def shingles(text):
    words = SPACE.findall((text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def jaccard_components(rows):
    """rows with distinct ids"""
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(doc, len(sets[doc]), root(doc)) for doc in docs}


def decontaminate(rows, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        words = TERM.findall((text or "").translate(UPPER))
        k = min(n, len(words))
        for i in range(len(words) - k + 1) if k else ():
            windows[tuple(words[i : i + k])].add("" if item is None else str(item))
    out = Counter()
    for doc, text in rows:
        words = TERM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(words[i : i + k])]
        out[doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)] += 1
    return out


def crc(text) -> int:
    return zlib.crc32((text or "").encode())


def periodic_runs(words, least=24, turns=3):
    """(start, length, period) by start, then period"""
    n, found = len(words), {}
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, turns * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def run_digests(doc, text):
    words = planted(doc, text)
    runs = periodic_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(rows, items, k=10):
    """{(item, rank, doc, score)}; rows and items with distinct ids or repeats"""
    counts = [(doc, Counter(WORD.findall((text or "").translate(UPPER)))) for doc, text in rows]
    counts = [(doc, c) for doc, c in counts if c]
    docs, total = len(counts), sum(c.total() for _, c in counts)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(WORD.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for t in terms if (df := sum(t in c for _, c in counts))}
        scores = []
        for doc, c in counts:
            m = 100 - 90 + 90 * c.total() * docs // total
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def vector_links(rows, cosine=0.9):
    """Counter of (vec_id, n_links, component_id, kept) for (vec_id, vector) rows"""
    good = []
    for at, (vec, x) in enumerate(rows):
        if vec is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            good.append((at, x, math.sqrt(math.fsum(v * v for v in x))))
    parent, links = list(range(len(rows))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x, a) in enumerate(good):
        for j, y, b in good[n + 1 :]:
            if len(x) == len(y) and math.fsum(p * q for p, q in zip(x, y)) / (a * b) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            least[root(i)] = min(vec, least.get(root(i), vec))
    return Counter((vec, links[i], None if vec is None else least[root(i)], vec is None or vec == least[root(i)]) for i, (vec, _) in enumerate(rows))
