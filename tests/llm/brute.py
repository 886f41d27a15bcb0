"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def remainder(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def groups(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def jaccard(rows, n, pct):
    """rows: distinct doc_id, text. doc_id: (n_shingles, component)."""
    sets = {}
    for d, t in rows:
        w = WORDS.findall(low(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b])]
    part = groups(ids, links)
    return {d: (len(sets[d]), part[d]) for d in ids}


def lines(rows):
    docs, out = defaultdict(set), {}
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(LAST if d is None else d)
    for d, t in rows:
        all_ = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and len(docs[key(x)]) > 1 and (LAST if d is None else d) > min(docs[key(x)]) for x in all_]
        out[d] = (len(all_), sum(gone), sha("\n".join(x for x, g in zip(all_, gone, strict=True) if not g)))
    return out


def windows(rows, k, split, join):
    """doc_id: (units, removed, spans, kept) for windows of k units that also start earlier."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        units = split((t or "").encode())
        gone = [False] * len(units)
        for i in range(len(units) - k + 1):
            w = tuple(units[i : i + k])
            if w in seen:
                gone[i : i + k] = [True] * k
            seen.add(w)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(units), sum(gone), spans, sha(join(u for u, g in zip(units, gone, strict=True) if not g)))
    return out


def benchmark_hits(rows, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    for d, t in rows:
        w = word.findall(low(t))
        hit, found = set(), set()
        for item, text in items:
            b = word.findall(low(text))
            n = min(size, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= {item} - {None}
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))))
    return out


def base_scores(rows):
    counts, total, ends = Counter(), 0, 0
    for d, t in rows:
        if remainder(d, 7) != 2:
            w = WORDS.findall(low(t))
            counts.update(w)
            total += len(w) + 1
            ends += 1
    v = len(counts) + (ends > 0)
    out = {}
    for d, t in rows:
        w = WORDS.findall(low(t))
        c = [counts[x] for x in w] + [ends]
        out[d] = (remainder(d, 7) == 2, len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + v + 1)) for x in c))
    return out


def ppm_scores(rows, order=5):
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    pad = b"\xfe" * order
    for d, t in rows:
        if remainder(d, 7) != 2:
            y = pad + low(t).encode() + b"\xff"
            for j in range(order, len(y)):
                for o in range(order + 1):
                    seen[o][y[j - o : j]][y[j]] += 1
    out = {}
    for d, t in rows:
        y, score = pad + low(t).encode() + b"\xff", 0.0
        for j in range(order, len(y)):
            gone = set()
            for o in range(order, -1, -1):
                c = {a: n for a, n in seen[o].get(y[j - o : j], {}).items() if a not in gone}
                if not c:
                    continue
                if y[j] in c:
                    score += math.log10(c[y[j]] / (sum(c.values()) + len(c)))
                    break
                score += math.log10(len(c) / (sum(c.values()) + len(c)))
                gone |= set(c)
            else:
                score -= math.log10(256 - len(gone))
        out[d] = score
    return out
