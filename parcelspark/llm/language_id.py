"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, runs of spaces one. All 1-, 2- and 3-grams of characters are
hashed into 2^16 features; a feature's value is its share of the text's n-grams times its inverse document frequency. The
document frequencies cover every labelled training document. The regression is fitted by follow-the-regularised-leader with
L1 and L2 penalties, on a bounded sample: at most `per_lang` training documents of each language, those of the smallest
hash of doc_id and text, a fifth of which is kept back to fit the softmax temperature; more than `most_langs` languages raise an
error. Whole texts are used everywhere.

The fitted table (2^16 rows, a column for each language) is all that goes to the executors; its size does not depend on
the corpus.

Defined results: a null text, and one without any letter, is `und` with score 0; with no training rows every text is `und`;
rows with a null lang are never trained on; a null doc_id is like any other; repeated rows are trained on once and predicted alike; of
languages that come out alike the first in code point order is given; very long texts are read in pieces of 2^20 characters; an empty
table gives an empty table; other columns are carried along, except that lang_pred and score replace columns of that name.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
UNKNOWN = "und"
#: Code points below this are looked up; higher ones (CJK and on) count as letters.
TABLED = 0x3000
SCALE = 10.0
PIECE = 1 << 20


def letters() -> np.ndarray:
    return np.array([c if chr(c).isalpha() else 32 for c in range(TABLED)], np.uint32)


def features(text: str, table: np.ndarray) -> np.ndarray:
    """How often each feature occurs. Texts go in pieces of PIECE characters, so memory is bounded; no n-gram spans two."""
    out = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(text), PIECE):
        out += np.bincount(_numbers(text[i : i + PIECE], table), minlength=len(out))
    return out


def _numbers(text: str, table: np.ndarray) -> np.ndarray:
    """The feature number of each n-gram of the text, with repeats."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    a = np.where(a < len(table), table[np.minimum(a, len(table) - 1)], a)
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))].astype(np.uint64)
    step = np.uint64(21)
    two = (a[:-1] << step) | a[1:]
    three = (two[:-1] << step) | a[2:]
    all_ = np.concatenate([a | np.uint64(1 << 62), two | np.uint64(2 << 62), three])
    return ((all_ * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # features x languages: inverse document frequency times weight
    temperature: float


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    letter_table = letters()

    def count(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                seen += features(t, letter_table) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.append(at, -1), "docs": np.append(seen[at], n)})

    rows = texts.mapInPandas(count, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()
    df, n = np.zeros(1 << BITS), 0
    for feature, docs in zip(rows["feature"], rows["docs"], strict=True):
        if feature < 0:
            n = int(docs)
        else:
            df[feature] = docs
    return np.log((1 + n) / (1 + df)) + 1, n


def _sample(rows: DataFrame, per_lang: int) -> pd.DataFrame:
    """lang, and feature numbers and counts, of at most per_lang distinct rows of each language.

    Ranks need only hashes and are cut on the map side; the few hashes go back to the texts by broadcast, so no other text moves.
    """
    letter_table = letters()
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    first = Window.partitionBy("lang").orderBy("_h")
    ids = rows.select("lang", "_h").withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= per_lang).distinct()

    def counted(batches):
        for batch in batches:
            found = [(np.flatnonzero(c), c[c > 0]) for c in (features(t, letter_table) for t in batch["text"])]
            yield pd.DataFrame({"lang": batch["lang"], "_n": batch["_n"], "at": [x[0] for x in found], "n": [x[1] for x in found]})

    out = rows.join(F.broadcast(ids), ["lang", "_h"]).groupBy("lang", "_n").agg(F.first("text").alias("text"))
    return out.mapInPandas(counted, "lang string, _n int, at array<long>, n array<long>").toPandas().sort_values(["_n", "lang"], kind="stable").reset_index(drop=True)


def fit_regression(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.3, beta: float = 0.05, l1: float = 2e-3, l2: float = 1e-3) -> np.ndarray:
    """Follow the regularised leader, one row at a time. rows: feature numbers, values, class."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(at=slice(None)):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights()


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least loss; 1 where there is nothing to fit on."""
    if not len(classes):
        return 1.0

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), classes]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    return float(min(grid, key=loss))


def train(docs: DataFrame, training: Column | None = None, per_lang: int = 400, most_langs: int = 256) -> LanguageModel:
    """Learns from text and lang of the rows where `training` holds (default: all) and neither is null."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(training) if training is not None else rows
    if rows.select("lang").distinct().limit(most_langs + 1).count() > most_langs:
        raise ValueError(f"more than {most_langs} languages to learn")
    sample = _sample(rows.select("doc_id", "lang", "text"), per_lang)
    langs = sorted(set(sample["lang"]))
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), 1.0)
    idf, _ = _document_frequencies(rows.select("text"))
    index = {x: i for i, x in enumerate(langs)}
    made = [(a, c / max(1, c.sum()) * idf[a] * SCALE, index[x]) for a, c, x in zip(sample["at"].map(lambda v: np.asarray(v, np.int64)), sample["n"].map(lambda v: np.asarray(v, np.int64)), sample["lang"], strict=True)]
    held = sample["_n"].to_numpy() % 5 == 0
    weights = fit_regression([r for r, h in zip(made, held, strict=True) if not h], len(langs))
    back = [r for r, h in zip(made, held, strict=True) if h]
    temperature = fit_temperature(np.array([x @ weights[at] for at, x, _ in back]).reshape(len(back), len(langs)), np.array([y for *_, y in back], int))
    return LanguageModel(langs, (weights * idf[:, None] * SCALE).astype(np.float32), temperature)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter_table = letters()

    @F.pandas_udf("lang string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = []
        for t in text:
            if t is None or not m.langs or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0))
                continue
            x, n = np.zeros(len(m.langs)), 0
            for i in range(0, len(t), PIECE):
                at = _numbers(t[i : i + PIECE], letter_table)
                x, n = x + m.table[at].sum(axis=0, dtype=np.float64), n + len(at)
            x = x / n / m.temperature
            p = np.exp(x - x.max())
            out.append((m.langs[int(p.argmax())], float(p.max() / p.sum())))
        return pd.DataFrame(out, columns=["lang", "score"])

    out = docs.withColumn("_p", run("text"))
    return out.withColumn("lang_pred", F.col("_p.lang")).withColumn("score", F.col("_p.score")).drop("_p")
