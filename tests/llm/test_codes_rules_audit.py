"""Vector codes, url filters and the filter audit, against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import filter_audit, url_filters, vector_codes
from parcelspark.llm.queries import URL_RULES

NAN, INF = float("nan"), float("inf")


# vector codes


def plain_codes(rows, parts, entries, rounds):
    """rows: vec_id, components, label. Whole numbers of any size, one vector at a time."""
    ok = [(i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ok[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v, _ in ok:
                mine[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(m) for x in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)])
        books = new
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), label) for i, v, label in ok]
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=repr)


def coded(df, **kw):
    return sorted((tuple(r) for r in vector_codes.compress(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_vector_codes(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=16) * (1 + i % 3)], [None, 1, 2, 3][i % 4]) for i in r.permutation(300) - 20]
    rows += [(1000, rows[0][1], 1), (rows[1][0], rows[2][1], 2), (None, rows[3][1], None), (None, rows[3][1], 3), (2001, [0.5] * 16, 1), (2002, [-0.0] * 16, 1)]
    odd = [(3000, None, 1), (3001, [], 1), (3002, [NAN] + [0.0] * 15, 1), (3003, [INF] * 16, 2), (3004, [None] * 16, 2)]
    want = plain_codes(rows, 8, 16, 6)
    df = spark.createDataFrame(rows + odd, VECTORS)
    for k in (1, 7):  # sums of whole numbers don't depend on the order
        assert coded(df.repartition(k)) == want
    clash = df.withColumns({c: F.lit("x") for c in ("code", "error", "vector", "_id", "block", "_label", "label_error")})
    assert coded(clash) == want
    assert coded(spark.createDataFrame(rows + [(4000, [1.0] * 8, 1), (4001, [1.0] * 15, 1), (4002, [70000.0] * 16, 1)], VECTORS)) == want  # other lengths, and what no long holds
    assert coded(spark.createDataFrame(rows[:5], VECTORS), parts=4, rounds=2) == plain_codes(rows[:5], 4, 16, 2)
    assert coded(spark.createDataFrame([], VECTORS)) == [] == coded(spark.createDataFrame(odd, VECTORS))


def test_vector_codes_of_copies(spark):
    """Half of all rows are one vector: entries that start equal tie to the lower one, and the others stay as they are."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 2 else [float(i), -1.0, i / 3, 0.25], 7) for i in range(200)]
    rows = [(i - 1000, rows[1][1], 7) for i in range(6)] + rows
    df = spark.createDataFrame(rows, VECTORS)
    assert coded(df, parts=2, entries=8, rounds=3) == plain_codes(rows, 2, 8, 3)


# url filters


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(x.lower() if x.isascii() else x for x in host)
    fits = [(len((h + p).encode()), len(h.encode()), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://Example.COM/en/1?x=/en/#y", "http://www.example.com/en/", "http://xexample.com/en/", "http://a.b.www.example.com/en", "http://www.example.com",
    "http://a.net/es/x", "http://net/fr/", "http://a.net/fr", "http://a.net?q=://www.example.com/en/", "x://y://com/", "http://.com/", "http://com./", "http://user@a.example.com:80/en/", "http://a.example.com:80/en/",
    "http://Éa.net/fr/é", "http://a.com/\n/en/", "http://" + "a." * 5000 + "example.com/en/" + "b" * 100000, "http://a.example.org/en/",
]


def judged(df, rules, **kw):
    return sorted((tuple(r) for r in url_filters.judge(df, rules, **kw).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_url_filters(spark):
    rows = [(i % 20 or None, u) for i, u in enumerate(URLS + URLS[:4])]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    want = sorted(((i, *plain_verdict(u, URL_RULES)) for i, u in rows), key=repr)
    assert judged(df, rules) == want
    assert {v for *_, v in want} == {"allow", "block"}
    clash = df.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "file", "shard", "digest")})
    assert judged(clash, rules) == want
    assert set(url_filters.judge(clash, rules).columns) == set(clash.columns)
    assert judged(spark.createDataFrame([], df.schema), rules) == []
    none = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", "/", None), ("com", "/", "deny"), ("a/b", "", "block")], rules.schema)
    assert judged(df, none, default="block") == sorted(((i, *plain_verdict(u, [], "block")) for i, u in rows), key=repr)


def test_many_rules_in_shards(spark, monkeypatch):
    r = random.Random(2)
    label = lambda: "".join(r.choices("abé", k=r.randint(1, 2)))
    host = lambda n: ".".join(label() for _ in range(r.randint(1, n)))
    path = lambda: r.choice(["", "/", "x"]) + "/".join(label() for _ in range(r.randint(0, 3)))
    rules = [(host(3), path(), r.choice(["allow", "block"])) for _ in range(3000)]
    rules += [(h, p, "block") for h, p, _ in rules[:50]]
    rows = [(i, f"http://{host(5)}/{path()}") for i in range(2000)]
    build = url_filters.build_index
    monkeypatch.setattr(url_filters, "build_index", lambda rules: build(rules, 1 << 12))
    got = judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert len(build(spark.createDataFrame(rules, "host string, path string, verdict string"), 1 << 12)[0]) > 3
    assert got == sorted(((i, *plain_verdict(u, rules)) for i, u in rows), key=repr)


def test_collisions_are_confirmed_and_passed_over():
    keys = [b"aa", b"b", b"", b"cccc", b"dd"]
    same = np.array([5, 5, 5, 9, 5])
    found = url_filters.DigestArray.build(keys, [0, 1, 2, 3, 4], same)
    asked = [*keys, b"zz", b"cccc", b"q"]
    at = found.find(asked, np.array([5, 5, 5, 9, 5, 5, 5, 11]))
    assert [int(found.values[i]) if i >= 0 else None for i in at] == [0, 1, 2, 3, 4, None, None, None]
    assert url_filters.DigestArray.build([], []).find([b"x"]).tolist() == [-1]


def test_digests_are_those_of_spark(spark):
    keys = ["", "a", "example.com", "é" * 40, "x" * 1000]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", F.xxhash64("k").alias("h"))
    assert {r["k"]: r["h"] for r in df.collect()} == dict(zip(keys, url_filters.digests([k.encode() for k in keys]).tolist(), strict=True))


def test_a_mapped_shard_is_the_one_written(tmp_path):
    shard = url_filters.Shard.build(pd.DataFrame(URL_RULES, columns=["host", "path", "verdict"]))
    (tmp_path / "f").write_bytes(shard.dump() + b"\n")
    back = url_filters.Shard.map(str(tmp_path / "f"))
    assert back.dump() == shard.dump() and isinstance(back.hosts.digest.base, np.ndarray) and back.deepest == 3
    (tmp_path / "g").write_bytes(bytes(100))
    with pytest.raises(ValueError):
        url_filters.Shard.map(str(tmp_path / "g"))


# filter audit


def plain_flags(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, _, t in rows]
    last = 1 << 63
    first = {}
    for d, _, t in rows:
        first[t or ""] = min(first.get(t or "", last), last if d is None else d)
    return [
        {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t or "")) > 5 * len(t or ""), "D": bool(re.search(r"[#$%&*|]", t or "")), "E": (last if d is None else d) > first[t or ""]}
        for (d, _, t), w in zip(rows, words, strict=True)
    ]


def plain_audit(rows, labels, names="ABCDE"):
    fails = plain_flags(rows)
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    out = []
    for part in {s or "" for _, s, _ in rows}:
        mine = [(d, f) for (d, s, _), f in zip(rows, fails, strict=True) if (s or "") == part]
        found, value = [], Counter()
        for order in permutations(names):
            stay = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in stay if r[1][x]]
                stay = [r for r in stay if not r[1][x]]
                value[x] += len(gone)
                lost = [sum(d is not None and d in s for d, _ in gone) for s in (good, toxic)]
                found.append((part, "".join(order), step, len(stay), len(gone), sum(f[x] for _, f in mine) - len(gone), sum(f[x] and sum(f[y] for y in names) == 1 for _, f in mine), *lost, x))
        out += [(*r[:-1], value[r[-1]]) for r in found]
    return sorted(out)


def audited(docs, labels):
    out = filter_audit.audit(filter_audit.flags(docs, labels))
    return sorted(tuple(r) for r in out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def texts(n=90):
    r = random.Random(8)
    out = []
    for i in range(n):
        few = ["ta", "ro", "Mi", "ZU", "é"] if i % 3 else [f"w{k}" for k in range(200)]
        out.append(" ".join(r.choice(few) for _ in range(r.choice([0, 3, 49, 50, 51, 120]))) + r.choice(["", "", " #", " a|b"]))
    return out


DOCS, LABELS = "doc_id long, source string, text string", "doc_id long, quality int, toxic int"


def test_filter_audit(spark):
    t = texts()
    rows = [(int(i * 7 % 90), [None, "", "a", "b"][i % 4], x) for i, x in enumerate(t)]
    rows += [(200, "a", None), (201, "b", ""), (202, "only", "x"), (203, "a", rows[3][2]), (rows[4][0], "a", rows[4][2]), (rows[5][0], "b", rows[9][2]), (None, "a", rows[8][2]), (None, None, "alone"), (None, "a", "alone")]
    rows += [(300, "a", "Wort " * 200000), (301, "c", "ok " * 49 + "ok"), (302, "c", " ".join(f"w{k}" for k in range(50)))]
    labels = [(d, d % 3 == 0, d % 5 == 0) for d in range(90)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (300, 1, 1), (999, 1, 1)]
    labels = [(d, None if q is None else int(q), None if x is None else int(x)) for d, q, x in labels]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    want = plain_audit(rows, labels)
    assert len(want) == 5 * 600 and any(r[7] for r in want) and any(r[8] for r in want)
    assert audited(docs.repartition(3), lab) == want
    clash = docs.withColumns({c: F.lit("x") for c in ("A", "E", "part", "good", "words", "_id", "state", "filter")})
    assert audited(clash, lab.withColumn("text", F.lit("x")).withColumn("part", F.lit("x"))) == want
    assert audited(docs, lab.limit(0)) == plain_audit(rows, [])
    assert audited(docs.limit(0), lab) == []


def test_paths_of_the_same_filters_share_a_state(spark):
    """31 states of five filters are counted, not the 206 inner nodes of the trie of permutations; and those counts are what is removed."""
    r = random.Random(1)
    rows = [("p", False, False, *[r.random() < 0.3 for _ in range(5)]) for _ in range(500)]
    df = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean, D boolean, E boolean")
    edges = filter_audit.walk(df, "ABCDE").collect()
    assert len({e["state"] for e in edges}) == 31 and len(edges) == 80
    for e in edges:
        stay = [x for x in rows if not any(x["ABCDE".index(f) + 3] for f in e["state"])]
        assert e["present"] == len(stay) and e["removed"] == sum(x["ABCDE".index(e["filter"]) + 3] for x in stay)
