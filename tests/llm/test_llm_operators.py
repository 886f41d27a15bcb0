"""Every operator on ordinary and on odd documents, against plain versions."""

import random
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from parcelspark.llm import decontaminate, embedding_dedup, jaccard_join, language_id, line_dedup, lm_scoring, mixing, substring_dedup, suffix_dedup, token_records  # noqa: E402
from parcelspark.llm.common import shared_path  # noqa: E402
from parcelspark.llm.queries import TOKENIZER, _remainder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "target", "copies", "kept", "n_lines", "n_words", "spans", "items", "block", "node", "score", "lang_pred", "_id", "m"]


def sample(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ro", "mi", "Élan", "x,", "9", "The", "zz."]) for _ in range(r.randint(1, 3)))
    texts = []
    for i in range(n):
        w = [word() for _ in range(r.randint(1, 120))]
        if i % 4 == 1:
            w = texts[r.randrange(len(texts))].split(" ")
            for _ in range(i % 3):
                w[r.randrange(len(w))] = word()
        if i % 5 == 2:
            old = texts[r.randrange(len(texts))].split(" ")
            w[len(w) // 2 : len(w) // 2] = old[: r.randint(1, 60)]
        texts.append(" ".join(w))
    rows = [(3 * i + 1, t.replace(" ", "\n", 3) if i % 6 == 0 else t, "abc"[i % 3], f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    odd = [(1000, None, None, None, None), (1001, "", "a", "s0", 0), (1002, " \n\t ", "b", None, 4), (1003, "1 2 3", "a", "s1", 5), (1004, "aaaa" * 3000, "a", "s9", 12000), (1005, "same line here\n" * 40, "b", "s9", 600), (1006, "\x00 NUL and \x1f\xa0  \U0001f600", "c", "s2", 9)]
    return rows + odd


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns whose names operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def repeated(spark, rows):
    """Two rows without doc_id, and rows that stand twice."""
    return spark.createDataFrame(rows[:8] + rows[:4] + [(None, rows[1][1], None, None, None), (None, None, "a", "s0", 1)], SCHEMA)


def by_id(df, *cols):
    return {r[0]: tuple(r)[1:] if len(cols) > 1 else r[1] for r in df.select("doc_id", *cols).collect()}


def test_line_dedup(docs, rows, empty, clash, repeated):
    got = lambda d: by_id(line_dedup.dedup_lines(d), "n_lines", "n_dropped", F.sha2("kept", 256))
    want = brute.lines([r[:2] for r in rows])
    assert got(docs) == want == got(clash)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(repeated).count() == repeated.count()
    more = by_id(line_dedup.dedup_lines(docs, min_docs=3), "n_dropped", "n_lines")
    assert all(more[d][0] <= want[d][1] for d in want)


def test_mixing(docs, rows, empty, clash, repeated):
    out = mixing.plan(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    size = {r[0]: len(brute.WORDS.findall(r[1] or "")) for r in rows}
    assert {d: r["size"] for d, r in got.items()} == size
    sources = {r["source"]: (r["source_size"], r["target"]) for r in got.values()}
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(0 <= r["copies"] <= 2 for r in got.values()) and all(t <= 2 * s + 1e-9 for s, t in sources.values())
    for s, (_, target) in sources.items():
        mine = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target) <= 2 * max(r["size"] for r in mine)
    assert {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()} == {d: r["copies"] for d, r in got.items()}
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(r["copies"] for r in got.values())
    assert mixing.mix(empty).count() == 0 and mixing.plan(repeated).count() == repeated.count()


def test_mixing_of_rows_alike(spark):
    """Rows of one doc_id or none, of one size: reruns take the same texts, however the rows are dealt."""
    rows = [(d, f"{w} {v}", "a" if i % 3 else "b") for i, w in enumerate("abcdefghij") for d in (1, None) for v in "xyz"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(repr, mixing.mix(df.repartition(k)).collect())) for k in (1, 5, 8)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 60


def test_targets_reshare_until_none_is_above(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 500), (True, "", 20)], "_none boolean, _key string, source_size long")
    got = {r["_key"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, weights, caps = 1.5 * 1530, {"a": 3, "b": 1, "c": 2, "": 3}, {"a": 20, "b": 2000, "c": 1000, "": 40}
    want = {}
    while True:
        rate = left / sum(weights[x] for x in weights if x not in want)
        over = [x for x in weights if x not in want and rate * weights[x] > caps[x]]
        if not over:
            break
        for x in over:
            want[x] = caps[x]
            left -= caps[x]
    want |= {x: rate * weights[x] for x in weights if x not in want}
    assert got == pytest.approx(want)


def test_language_id(docs, empty, clash, repeated):
    model = language_id.train(docs)
    out = by_id(language_id.predict(clash, model), "lang_pred", "score")
    assert out[1000] == out[1001] == out[1002] == out[1003] == ("und", 0.0)
    assert all(p in "abc" and 0 < s <= 1 for d, (p, s) in out.items() if d < 1000)
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.predict(repeated, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_language_id_held_out(spark):
    r = random.Random(1)
    sounds = {"x": ["ka", "shi", "no", "ra"], "y": ["sch", "ung", "ein", "er"], "z": ["tion", "que", "é", "ment"]}
    rows = [(i, " ".join("".join(r.choice(sounds[s]) for _ in range(3)) for _ in range(40)), s, "s", 0) for i in range(300) for s in [r.choice("xyz")]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("held", _remainder(4) == 2)
    got = language_id.predict(docs, language_id.train(docs, ~F.col("held"))).where("held").select("lang", "lang_pred").collect()
    assert len(got) > 40 and sum(a == b for a, b in got) / len(got) > 0.97


def test_sample_of_one_id_is_bounded(spark):
    """Many rows of one doc_id, or none, are no more than per_lang distinct ones a language."""
    rows = [(7, f"word{i}", "a", "s", 0) for i in range(300)] + [(None, f"other{i % 5}", "b", "s", 0) for i in range(300)]
    got = language_id._sample(spark.createDataFrame(rows, SCHEMA), 40)
    assert got.groupby("lang").size().to_dict() == {"a": 40, "b": 5}
    with pytest.raises(ValueError, match="more than 1 languages"):
        language_id.train(spark.createDataFrame(rows, SCHEMA), most_langs=1)


def test_language_model_against_a_plain_one(spark):
    """Every step again with dicts: n-grams, TF-IDF, the regression row by row, the temperature, the probabilities."""
    r = random.Random(4)
    sounds = {"x": ["ka", "shi", "no"], "y": ["sch", "ung", "ein"], "z": ["tion", "que", "\u00e9"]}
    rows = [(i, " ".join("".join(r.choice(sounds[s]) for _ in range(2)) for _ in range(r.randint(1, 12))) + " 12,", s, "s", 0) for i in range(60) for s in [r.choice("xyz")]]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(df, per_lang=12)
    number = lambda g: int(((sum(c << (21 * (len(g) - 1 - i)) for i, c in enumerate(map(ord, g))) | {1: 1, 2: 2, 3: 0}[len(g)] << 62) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)

    def grams(text):
        t = f" {text.lower()} "
        t = "".join(ch if ch.isalpha() else " " for ch in t)
        while "  " in t:
            t = t.replace("  ", " ")
        return brute.Counter(number(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))

    found = [grams(t) for _, t, *_ in rows]
    seen = brute.Counter(g for f in found for g in f)
    idf = lambda g: brute.math.log((1 + len(rows)) / (1 + seen[g])) + 1
    vector = lambda f: {g: c / sum(f.values()) * idf(g) * 10 for g, c in f.items()}
    ranks = {}
    for lang in "xyz":
        hashes = sorted((h, i) for i, l, h in df.select("doc_id", "lang", F.xxhash64("doc_id", "text")).collect() if l == lang)
        ranks |= {i: k + 1 for k, (_, i) in enumerate(hashes[:12])}
    sample = sorted((ranks[i], l, i) for i, _, l, *_ in rows if i in ranks)
    z, n, alpha, beta, l1, l2 = brute.defaultdict(float), brute.defaultdict(float), 0.3, 0.05, 2e-3, 1e-3
    weight = lambda g, k: 0.0 if abs(z[g, k]) <= l1 else -(z[g, k] - brute.math.copysign(l1, z[g, k])) / ((beta + n[g, k] ** 0.5) / alpha + l2)

    def softmax(x):
        e = [brute.math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    logits = lambda v: [sum(x * weight(g, k) for g, x in v.items()) for k in "xyz"]
    for _ in range(4):
        for rank, lang, i in sample:
            if rank % 5:
                v = vector(found[i])
                w = {(g, k): weight(g, k) for g in v for k in "xyz"}
                for k, p in zip("xyz", softmax(logits(v)), strict=True):
                    for g, x in v.items():
                        d = x * (p - (k == lang))
                        z[g, k] += d - ((n[g, k] + d * d) ** 0.5 - n[g, k] ** 0.5) / alpha * w[g, k]
                        n[g, k] += d * d
    back = [(logits(vector(found[i])), "xyz".index(lang)) for rank, lang, i in sample if rank % 5 == 0]
    loss = lambda t: -sum(brute.math.log(softmax([v / t for v in x])[y]) for x, y in back)
    steps = [brute.math.exp(brute.math.log(0.05) + i / 240 * (brute.math.log(20) - brute.math.log(0.05))) for i in range(241)]
    best = min(steps, key=loss)
    assert model.temperature == pytest.approx(best, rel=1e-6)
    for i, (lang, score) in by_id(language_id.predict(df, model), "lang_pred", "score").items():
        p = softmax([v / best for v in logits(vector(found[i]))])
        assert lang == "xyz"[p.index(max(p))] and score == pytest.approx(max(p), rel=1e-4)


def test_jaccard_join(docs, rows, empty, clash, repeated):
    for n, pct, deal in ((4, 85, "parts"), (5, 80, "rare"), (1, 60, "parts"), (1, 60, "rare")):
        assert by_id(jaccard_join.link_documents(docs, n=n, pct=pct, deal=deal), "n_shingles", "component_id") == brute.jaccard([r[:2] for r in rows], n, pct)
    part = brute.jaccard([r[:2] for r in rows], 5, 80)
    kept = jaccard_join.drop_near_copies(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {d for d in part if part[d][1] == d}
    assert jaccard_join.link_documents(empty).count() == 0 and jaccard_join.drop_near_copies(empty).count() == 0
    assert jaccard_join.link_documents(repeated).count() == repeated.count()


def test_prefix_tree_finds_what_all_pairs_connect():
    r = random.Random(5)
    for _ in range(60):
        base = [frozenset(r.sample(range(60), r.randint(1, 25))) for _ in range(4)]
        sets = list({frozenset(set(b) ^ set(r.sample(range(60), r.randint(0, 3)))) for b in base for _ in range(5)} - {frozenset()})
        want = brute.groups(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])])
        got = brute.groups(range(len(sets)), jaccard_join.tree_links([np.array(sorted(s), np.uint64) for s in sets], 70))
        assert got == want


def test_similar_sets_share_a_signature():
    """Pairs at the very edge of the similarity, of all sizes."""
    r = np.random.default_rng(6)
    for pct in (60, 80, 85, 99):
        classes = jaccard_join.size_classes(pct)
        for _ in range(400):
            n = int(np.exp(r.uniform(0, 7)))
            base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(r.integers(0, (100 - pct) * len(base) // 100 + 1))
            left = base[gone:]
            most = 100 * len(left) // pct - len(base)  # shingles that may be added
            other = np.union1d(left, r.integers(0, 1 << 63, int(r.integers(0, most + 1)), dtype=np.uint64))
            assert 100 * len(np.intersect1d(base, other)) >= pct * len(np.union1d(base, other))
            if len(base) != len(other) or (base != other).any():
                assert len(np.intersect1d(jaccard_join.signatures(base, pct, classes), jaccard_join.signatures(other, pct, classes)))


def test_large_groups_meet_chunk_by_chunk(spark, monkeypatch):
    """Several components that share passages, each larger than a group or smaller."""
    monkeypatch.setattr(jaccard_join, "GROUP", 1200)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common, rows = [word() for _ in range(160)], []
    for kind in range(6):
        own = [word() for _ in range(30)]
        for _ in range(3 if kind % 2 else 15):
            rows.append((len(rows), " ".join(common + own[: r.randint(24, 30)] + [word() for _ in range(r.randint(0, 6))])))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for pct, deal in ((75, "rare"), (85, "parts"), (90, "rare")):
        assert by_id(jaccard_join.link_documents(docs, n=2, pct=pct, deal=deal), "n_shingles", "component_id") == brute.jaccard(rows, 2, pct)


def test_decontamination(spark, docs, rows, empty, clash, repeated):
    texts = [r[1] for r in rows[:6]]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, "ta"), (10, texts[3].upper()), (11, texts[3]), (12, None), (13, " ;; "), (None, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    ids = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256)
    out = decontaminate.find_items(docs, bench)
    assert by_id(out, "n_words", "n_hit", F.size("items"), ids) == brute.benchmark_hits([r[:2] for r in rows], items)
    named = decontaminate.find_items(docs, bench.withColumn("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string"))))
    assert {d: len(i) for d, i in by_id(named, "items").items()} == {d: len(i) for d, i in by_id(out, "items").items()}
    with pytest.raises(ValueError, match="more than the 200"):
        decontaminate.find_items(docs, bench, most_bytes=200)
    clean = decontaminate.decontaminate(clash, bench)
    assert clean.columns == clash.columns and clean.count() == out.where("n_hit = 0").count()
    original = {r["doc_id"]: (r["text"], r["original"]) for r in decontaminate.find_items(docs, spark.createDataFrame(items[:1], bench.schema), offsets=True).collect()}
    text, spans = original[1]
    assert text.encode()[spans[0]["start"] : spans[0]["end"]].decode() in text
    none = bench.limit(0)
    assert decontaminate.find_items(repeated, none).where("n_hit > 0").count() == 0 and decontaminate.find_items(empty, bench).count() == 0


def whole_ids(rows, end_id=1):
    """doc_id and text in record order: start, number of ids, checksum, ids."""
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        want.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return want


def test_token_records(spark, docs, rows, empty, clash):
    special = [(2000, "Don't <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>, it's U.S., 3,5. ok,", None, None, None), (2001, "\u00e9 A\u030a,x \u0130. \u3000wide\u2003space ,. a,", None, None, None)]
    want = whole_ids(sorted((r[0], r[1]) for r in rows + special))
    path = shared_path(spark, "t")
    index = token_records.write_records(docs.union(spark.createDataFrame(special, SCHEMA)), path, TOKENIZER, shard_bytes=4000)
    assert index.select("shard").distinct().count() > 1
    assert sorted(map(tuple, token_records.offsets(index).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == [w[:4] for w in want]
    for seed in (None, 1):
        assert {r["doc_id"]: r["ids"] for r in token_records.read_records(spark, path, seed).collect()} == {w[0]: w[4] for w in want}
    some = token_records.read_records(spark, path, index=index.where("doc_id % 7 = 1")).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {w[0]: w[4] for w in want if w[0] % 7 == 1}
    assert token_records.write_records(clash, shared_path(spark, "t"), TOKENIZER).agg(F.sum("n_tokens")).first()[0] == sum(w[2] for w in want if w[0] < 2000)
    assert token_records.write_records(empty, shared_path(spark, "t"), TOKENIZER).count() == 0


def test_a_task_keeps_no_encoder_when_it_ends():
    import gc
    from types import SimpleNamespace

    import pandas as pd

    run = token_records._encoder(SimpleNamespace(value=Path(TOKENIZER).read_text(encoding="utf-8")), 1, True)
    batch = pd.DataFrame({"doc_id": pd.array([1, None], "Int64"), "text": ["some words here", None]})
    gc.disable()  # let go without waiting for a collection
    try:
        frames = [f for out in run(iter([batch])) for f in out["frame"]]
        assert not [o for o in gc.get_objects() if isinstance(o, token_records.ChunkEncoder)]
    finally:
        gc.enable()
    assert len(frames) == 2 and token_records.record(frames[1] + b"\n", 0)[1] is None


def test_token_records_of_shared_ids_and_long_texts(spark):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    df = spark.createDataFrame([*shared_ids(), (3, long)], "doc_id long, text string").repartition(3)
    want = whole_ids([tuple(x) for x in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()])
    index = token_records.write_records(df, shared_path(spark, "t"), TOKENIZER, shard_bytes=100_000)
    got = [tuple(x) for x in token_records.offsets(index).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda x: x[1]) == [w[:4] for w in want]


def test_tokenizers_that_need_whole_texts(spark, tmp_path):
    """The shortcut by chunks is only taken where it gives what whole texts give."""
    import json

    from tokenizers import Tokenizer

    assert token_records.splits(Tokenizer.from_file(TOKENIZER))
    definition = json.loads(Path(TOKENIZER).read_text())
    definition["normalizer"]["normalizers"] = definition["normalizer"]["normalizers"][:2]  # A-Z stay
    (tmp_path / "t.json").write_text(json.dumps(definition))
    cased = Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not token_records.splits(cased)
    text = "Some Text WITH capitals,\nand lines."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    path = shared_path(spark, "t")
    token_records.write_records(df, path, str(tmp_path / "t.json"))
    assert dict(token_records.read_records(spark, path).collect()) == {1: cased.encode(text, add_special_tokens=False).ids + [1], 2: [1]}


def test_ids_of_large_vocabularies_take_four_bytes():
    data = token_records.frame(7, np.array([1, 70_000], "<u4").tobytes(), 4) + b"\n"
    ((at, _, doc_id, ids),) = token_records.records(data)
    assert (at, doc_id, ids.tolist()) == (0, 7, [1, 70_000])


def test_damaged_records_are_refused():
    data = b"".join(token_records.frame(i, struct.pack("<3H", 1, 2, i)) + b"\n" for i in (5, 6))
    assert [(r[2], r[3].tolist()) for r in token_records.records(data)] == [(i, [1, 2, i]) for i in (5, 6)]
    for at in (3, 9, 20, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.records(bytes(broken)))


def test_substring_dedup(docs, rows, empty, clash, repeated):
    want = {d: (n, m, k) for d, (n, m, _, k) in brute.windows([r[:2] for r in rows], 20, bytes.split, b" ".join).items()}
    assert by_id(substring_dedup.remove_repeats(docs), "n_words", "n_removed", F.sha2("kept", 256)) == want
    assert by_id(substring_dedup.remove_repeats(clash), "n_words", "n_removed", F.sha2("kept", 256)) == want
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.remove_repeats(repeated).count() == repeated.count()


def test_suffix_dedup(docs, rows, empty, clash, repeated):
    want = brute.windows([r[:2] for r in rows], 100, lambda b: [b[i : i + 1] for i in range(len(b))], b"".join)
    cols = ("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert by_id(suffix_dedup.remove_repeats(docs), *cols) == want == by_id(suffix_dedup.remove_repeats(clash), *cols)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.remove_repeats(repeated).count() == repeated.count()


def test_suffix_dedup_of_a_passage_that_many_share(spark, monkeypatch):
    """The strings that a minimizer has in very many documents never meet in one group, whatever their number, and with the same result."""
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = word(130), word(70)
    rows = [(i, word(r.randint(0, 90)) + (passage if i % 3 else other + passage) + word(r.randint(0, 90))) for i in range(240)]
    want = brute.windows(rows, 100, lambda b: [b[i : i + 1] for i in range(len(b))], b"".join)
    solve, most = suffix_dedup.repeats, 3000

    def bounded(strings, docs, starts, k):
        if sum(map(len, strings)) > 2 * most + 200:
            raise AssertionError("a group of all that share a passage")
        return solve(strings, docs, starts, k)

    monkeypatch.setattr(suffix_dedup, "repeats", bounded)
    monkeypatch.setattr(suffix_dedup, "UNIT", most)
    monkeypatch.setattr(suffix_dedup, "GROUP", most)
    monkeypatch.setattr(suffix_dedup, "PASSED", 500, raising=False)
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert got == want and sum(n[1] for n in got.values()) > 20_000


def test_merged_transforms_find_all_repeats():
    r = random.Random(2)
    for _ in range(60):
        k = r.choice([3, 5, 9, 20])
        strings = ["".join(r.choice("ab") for _ in range(r.randint(k, 60))).encode() for _ in range(r.randint(1, 12))]
        docs, starts = [r.randint(0, 4) for _ in strings], [1000 * i for i in range(len(strings))]
        at = {}
        for s, d, p in zip(strings, docs, starts, strict=True):
            for i in range(len(s) - k + 1):
                at.setdefault(s[i : i + k], []).append((d, p + i))
        d, p = suffix_dedup.repeats(strings, docs, starts, k)
        assert sorted(zip(d.tolist(), p.tolist(), strict=True)) == sorted(c for v in at.values() for c in v if c != min(v))


def test_lm_scoring(docs, rows, empty, repeated):
    out = lm_scoring.score_documents(docs, _remainder(7) == 2)
    got = by_id(out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    base, score = brute.base_scores([r[:2] for r in rows]), brute.ppm_scores([r[:2] for r in rows])
    assert {d: g[:4] for d, g in got.items()} == {d: b[:4] for d, b in base.items()}
    for d, g in got.items():
        assert g[4] == pytest.approx(base[d][4]) and g[5] == pytest.approx(score[d])
    assert lm_scoring.score_documents(empty, _remainder(7) == 2).count() == 0
    assert lm_scoring.score_documents(repeated, _remainder(7) == 2).count() == repeated.count()
    assert lm_scoring.score_documents(repeated, F.lit(True)).where("n_known > 0").count() == 0


def vectors(seed=4, n=300, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    for i in range(n, 2 * n):
        v = base[r.integers(n // 4)]
        rows.append((i, [float(x) for x in (v if i % 3 else v + r.normal(size=dim) * 0.05 * np.abs(v).mean())]))
    return rows + [(9000, None), (9001, [0.0] * dim), (9002, [float("nan")] + [1.0] * (dim - 1)), (9003, [float("inf")] * dim), (9004, []), (9005, [None] * dim), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [-0.0] * dim)]


def test_embedding_dedup(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("rep", "weight", "pivot", "pivots", "chunk", "_id", "vector")})
    got = {r[0]: tuple(r)[1:] for r in embedding_dedup.link_vectors(df.repartition(3)).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    found = sum(n for n, _, _ in got.values()) / 2
    assert 0.9 * len(links) <= found <= len(links) and len(links) > 300
    assert all(got[i] == (0, i, True) for i, _ in rows if i not in ok)
    part = brute.groups([i for i, _ in rows], links)
    assert sum(part[i] == got[i][1] for i, _ in rows) >= 0.95 * len(rows)
    assert got[9006][0] == 1 and got[9007][1] == 9006
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(r[1] for r in embedding_dedup.link_vectors(twice).collect()) == [0, 2, 2, 2]


def test_permutations_and_shared_pivots():
    """The index by itself: order of nearness, shared counts, and each linked pair taken in one list."""
    r = np.random.default_rng(3)
    pivots = [embedding_dedup.unit(v) for v in r.normal(size=(60, 8))]
    base = r.normal(size=(40, 8))
    x = np.concatenate([base, base + r.normal(size=(40, 8)) * 0.05])
    shared = type("Shared", (), {"value": pivots})
    import pandas as pd

    (posted,) = embedding_dedup._posted(shared, 8)([pd.DataFrame({"rep": range(80), "weight": 1, "vector": list(x)})])
    for v, p in zip(x, posted["pivots"], strict=True):
        assert p == sorted(range(60), key=lambda k: -float(pivots[k] @ embedding_dedup.unit(v)))[:8]
    lists = np.array(posted["pivots"].to_list())
    for n in (1, 2, 5):
        i, j = embedding_dedup.candidates(lists, None, n)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for b in range(80) for a in range(b) if len({*lists[a]} & {*lists[b]}) >= n}
    taken = []
    for pivot in range(60):
        rows = posted[[pivot in p for p in posted["pivots"]]].assign(chunk=0)
        if len(rows):
            taken += embedding_dedup._linked(0.95, 2)((pivot, 0, 0), rows)["links"].tolist()
    u = embedding_dedup.unit(x)
    want = [(a, b) for b in range(80) for a in range(b) if u[a] @ u[b] >= 0.95 and len({*lists[a]} & {*lists[b]}) >= 2]
    assert sum(taken) == 2 * len(want) and len(want) >= 40


def test_long_lists_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    r = np.random.default_rng(0)
    base = r.normal(size=8)
    rows = [(i, [float(x) for x in base + r.normal(size=8) * 0.02]) for i in range(150)]
    out = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(149, 0)}


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, rows[0][1])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert docs.columns == SCHEMA.replace(",", "").split()[::2] or name == "token_output"
    text = {r[0]: r[1] for r in rows}
    first = {r["doc_id"] for r in kept["language"]}
    assert {1000, 1001, 1002, 1003}.isdisjoint(first)
    part = brute.jaccard([(d, text[d]) for d in first], 5, 80)
    second = {d for d in first if part[d][1] == d}
    assert {r["doc_id"] for r in kept["near_copies"]} == second
    hits = brute.benchmark_hits([(d, text[d]) for d in second], bench)
    third = {d for d in second if not hits[d][1]}
    assert {r["doc_id"] for r in kept["decontamination"]} == third and 1 not in third
    assert {r["doc_id"] for r in kept["mixture"]} <= third and len(kept["mixture"]) > len(third)
    assert sorted(r["doc_id"] for r in kept["token_output"]) == sorted(r["doc_id"] for r in kept["mixture"])


def shared_ids():
    """Rows of one doc_id and rows without one: different texts, copies of each other, one longer than the other."""
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = text(90), text(40), text(30), text(60), text(25)
    return [(1, a), (7, b), (7, b), (7, c + " " + a), (7, e), (None, d), (None, d), (None, c), (None, e + " " + text(50)), (None, text(22)), (None, None), (None, "few words"), (None, "few words")]


def sources_in_order(rows, split, k, join):
    """(doc_id, text, kept) of each row where every row is a source; rows of an id come in any order, so the one got is replayed."""
    seen, out = set(), []
    for i, t in rows:
        u = split((t or "").encode())
        gone = [False] * len(u)
        for p in range(len(u) - k + 1):
            w = tuple(u[p : p + k])
            if w in seen:
                gone[p : p + k] = [True] * k
            seen.add(w)
        out.append((i, t, join([x for x, g in zip(u, gone, strict=True) if not g])))
    return out


def in_key_order(spark, rows):
    """Rows by doc_id, null last, then by the hash of their text."""
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in made.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()]


def test_substring_dedup_takes_rows_of_one_id_apart(spark):
    rows = shared_ids()
    want = sources_in_order(in_key_order(spark, rows), bytes.split, 20, b" ".join)
    for parts in (1, 4):
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).select("doc_id", "text", "kept").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, t, k.decode())) for i, t, k in want)


def test_suffix_dedup_takes_rows_of_one_id_apart(spark):
    rows = shared_ids()
    want = sources_in_order(in_key_order(spark, rows), lambda b: [b[i : i + 1] for i in range(len(b))], 100, b"".join)
    for parts in (1, 4):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).select("doc_id", "text", "kept").collect()
        assert sorted(repr((r[0], r[1], bytes(r[2]))) for r in got) == sorted(map(repr, want))


def test_line_dedup_takes_rows_of_one_id_apart(spark):
    said, own, more = "this line stands twice", "only this row has it", "and this is one more"
    rows = [(1, said), (7, f"{own}\n{said}"), (7, f"{said}\n{own} too"), (7, f"{said}\n{own} too"), (None, f"{said}\n{more}"), (None, f"{more} 2\n{said}\n{more}"), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    want = [(1, 1, 0, said), (7, 2, 1, own), (7, 2, 1, f"{own} too"), (7, 2, 1, f"{own} too"), (None, 2, 1, more), (None, 3, 1, f"{more} 2\n{more}"), (None, 1, 0, "")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_near_copies_are_dropped_row_by_row(spark):
    r = random.Random(9)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (5, b), (7, a + " end"), (7, c), (7, c), (8, d), (None, b + " end"), (None, e), (None, e + " end"), (None, e), (None, f), (None, d), (None, None), (None, " "), (9, ""), (9, "")]
    want = [(1, a), (5, b), (7, c), (8, d), (None, f), (None, None), (None, " "), (9, ""), (9, "")]
    got = [tuple(x) for x in jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    one = [x for x in got if x[0] is None and (x[1] or "").startswith(e)]
    assert len(one) == 1 and sorted(map(repr, got)) == sorted(map(repr, want + one))


def test_second_hash_does_not_follow_from_the_first(spark):
    """xxhash64(key, 7) is a function of xxhash64(key), so lines that collide in the one would in the other."""
    one = spark.createDataFrame([(1, "A line of some length")], "doc_id long, text string")
    got = line_dedup._lines(one, "text", 10).select("_h1", "_h2").first()
    key = "a line of some length"
    chained = one.select(F.xxhash64(F.lit(key)), F.xxhash64(F.lit(key), F.lit(7))).first()
    assert got["_h1"] == chained[0] and got["_h2"] != chained[1]


def test_texts_without_doc_ids_are_fetched_one_by_one(spark):
    """As many texts go into the groups as there are candidates, whether they have ids, none, or one and the same; equal rows of a task go once."""
    base = [f"{w} " + " ".join(f"{w}{k}" for k in range(30)) for w in (f"p{i}" for i in range(50))]
    texts = [t for b in base for t in (b, b + " more")]
    for ids in (range(100), [None] * 100, [7] * 100):
        df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True) for _ in range(2)], "doc_id long, text string").coalesce(1)
        slim = df.select(F.coalesce("doc_id", F.lit(jaccard_join.LAST)).alias("_id"), "text")
        wanted = slim.select("_id", F.xxhash64("text").alias("_sub")).distinct().withColumn("node", F.xxhash64("_id", "_sub"))
        got = jaccard_join.texts_of(wanted, slim)
        assert got.count() == 100 and {r["text"] for r in got.collect()} == set(texts)
        assert jaccard_join.drop_near_copies(df, n=5, pct=80).count() == 50
        assert jaccard_join.drop_near_copies(df, n=5, pct=80, deal="rare").count() == 50


def test_very_long_texts_cross_pieces(spark, monkeypatch):
    """Texts of more than 2^20 characters, with a repeat that lies over the seam of two pieces."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    long_ = " ".join(word() for _ in range(200000))
    assert len(long_) > suffix_dedup.PIECE == language_id.PIECE == 1 << 20
    seam = long_[suffix_dedup.PIECE - 130 : suffix_dedup.PIECE + 120]
    rows = [(1, long_), (2, f"{word()} {seam} {word()}"), (3, word())]
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "n_spans").collect()}
    assert got[1] == got[3] == (0, 0) and got[2][1] == 1 and 250 <= got[2][0] <= 252
    model = language_id.train(spark.createDataFrame([(i, t, lang) for i in range(8) for t, lang in (("the cat and the dog sat", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string"))
    texts = [(1, "the cat and the dog " * 60000), (2, " " * (1 << 20) + "der hund und die katze"), (3, "1 " * (1 << 20))]
    out = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert out == {1: "en", 2: "de", 3: "und"}


def test_lm_scoring_of_clashing_columns(docs, clash):
    cols = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert by_id(lm_scoring.score_documents(clash, _remainder(7) == 2), *cols) == by_id(lm_scoring.score_documents(docs, _remainder(7) == 2), *cols)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_of_odd_rows(spark, tmp_path, rows, kind):
    """Null and repeated doc_ids, rows that stand twice, columns with names that operators use; and a table without rows."""
    import corpus_pipeline

    odd = [*rows[:20], *rows[:3], (None, rows[5][1], "a", "s0", 1), (None, rows[6][1] + " and more of it", "b", None, 2), (7, rows[8][1], "a", "s1", 3), (None, None, None, None, None)] if kind == "odd" else []
    odd = [(r[0], r[1], r[2] and "a", *r[3:]) for r in odd]  # one language, which nothing can be taken for another
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "node", "kept", "_id", "copies", "component")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, columns = {r["text"] for r in docs.select("text").collect()} if name != "token_output" else set(), docs.columns
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        n, docs = docs.count(), spark.read.parquet(f"{tmp_path}/{name}")
        if name == "token_output":
            assert docs.count() == n
        else:
            assert docs.columns == columns and {r["text"] for r in docs.select("text").collect()} <= before
        if name == "near_copies" and odd:
            texts = [r["text"] for r in docs.collect()]
            assert len(texts) == len(set(texts)) and rows[5][1] in texts
    assert (docs.count() > 0) == (kind == "odd")
