"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z to a-z, every other ASCII character that is no digit or letter to a space; words are
the runs that remain (bytes above 127 belong to words). The patterns are all windows of `size` consecutive words of the
items, an item of fewer words being one window, with a space at either end. One automaton holds all of them and each text is
scanned once. Normalising keeps the length, so word numbers map straight to byte offsets of the original text.

The windows are made and grouped in Spark; the distinct ones and the items that hold them go to all tasks, where each task
builds the automaton once and keeps it for all its batches. The benchmark doesn't grow with the corpus, but what is broadcast is
checked all the same: more than `most_bytes` of windows raise an error, as one automaton then doesn't fit a task.

Defined results: a null or empty text has no words and no hits; null items and items without words are never found; a window of
an item without item_id counts as a hit, but adds no item; items of equal text are all found, and so are rows of one item_id, as one item;
an empty benchmark finds nothing; repeated rows are scanned like any other; a very long text is scanned in one go, in some 20 bytes
of memory a character; other columns are carried along, except that the added columns replace any of the same name. item_id may have
any type that casts to a string; items come in ascending order of it.
"""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut

#: Bytes to normalised bytes.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _windows(size: int):
    """Rows of item and window (Latin-1 view of its bytes, a space at either end)."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = (text or "").encode().translate(TABLE).split()
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    out.append((item, (b" " + b" ".join(words[i : i + size]) + b" ").decode("latin-1")))
            yield pd.DataFrame(out, columns=["item", "window"])

    return run


def automaton(windows: dict[str, list[str]]) -> ahocorasick.Automaton:
    """windows: items by window."""
    out = ahocorasick.Automaton()
    for window, items in windows.items():
        out.add_word(window, (len(window), window.count(" ") - 1, items))
    out.make_automaton()
    return out


#: The windows and their automaton. The package travels to the tasks by value, so each task has its own.
_BUILT: list = [None, None]


def built(shared) -> ahocorasick.Automaton:
    if _BUILT[0] is not shared.value:
        _BUILT[:] = shared.value, automaton(shared.value)
    return _BUILT[1]


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[int], list[str]]:
    """Number of words, the merged word ranges [from, to, from, to ...] that are hit, and the items found."""
    words = (text or "").encode().translate(TABLE).split()
    if not words or not len(machine):
        return len(words), [], []
    line = b" " + b" ".join(words) + b" "
    ends: dict[int, int] = {}
    items: set[str] = set()
    for end, (length, n, found) in machine.iter(line.decode("latin-1")):
        ends[end - length + 1] = max(n, ends.get(end - length + 1, 0))
        items.update(found)
    if not ends:
        return len(words), [], []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    merged: list[int] = []
    for a, b in sorted((int(np.searchsorted(gaps, at)), n) for at, n in ends.items()):
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], a + b)
        else:
            merged += [a, a + b]
    return len(words), merged, sorted(items)


def _scanner(shared):
    @F.pandas_udf("n_words long, spans array<int>, items array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = built(shared)
        for text in texts:
            yield pd.DataFrame([scan(t, machine) for t in text], columns=["n_words", "spans", "items"])

    return run


def byte_spans(text: str, spans: list[int]) -> list[tuple[int, int]]:
    """Word ranges as byte ranges of the original UTF-8 text."""
    inside = np.frombuffer(text.encode().translate(TABLE), np.uint8) != 32
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(spans[::2], spans[1::2], strict=True)]


def _original(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None or s is None or not len(s) else [{"start": a, "end": b} for a, b in byte_spans(t, [int(x) for x in s])] for t, s in zip(text, spans, strict=True)])


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 64 << 20, offsets: bool = False) -> DataFrame:
    """docs with n_words, n_hit, items (ids, ascending), spans (word ranges) and, with offsets, original (byte ranges)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    windows = cut(items.mapInPandas(_windows(size), "item string, window string").groupBy("window").agg(F.collect_set("item").alias("items")))
    needs = windows.agg(F.coalesce(F.sum(F.length("window") + 8 * F.size("items")), F.lit(0))).first()[0]
    if needs > most_bytes:
        raise ValueError(f"the benchmark has {needs} bytes of windows, more than the {most_bytes} that one automaton may have")
    rows = windows.toPandas()
    shared = spark.sparkContext.broadcast({w: list(i) for w, i in zip(rows["window"], rows["items"], strict=True)})
    out = docs.withColumn("_found", _scanner(shared)("text"))
    hit = F.aggregate("_found.spans", F.lit(0), lambda x, y: y - x)  # alternating signs: the ranges' total length
    found = F.array_sort(F.transform("_found.items", lambda x: x.cast(benchmark.schema["item_id"].dataType)))
    out = out.withColumns({"n_words": F.col("_found.n_words"), "n_hit": hit.cast("long"), "items": found, "spans": F.col("_found.spans")})
    if offsets:
        out = out.withColumn("original", F.pandas_udf(_original, "array<struct<start:int,end:int>>")("text", "spans"))
    return out.drop("_found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any word of a benchmark window, unchanged."""
    found = find_items(docs.select(F.struct("*").alias("_row"), "text"), benchmark, **how)
    return found.where("n_hit = 0").select("_row.*")


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
