"""LM scoring by prediction by partial matching over bytes, pretrained on the corpus.

The model is a trie of byte contexts up to ORDER long with the counts of the byte that follows, gathered from all training documents;
nothing is pruned, so it grows with the corpus. A byte's probability comes from its longest context seen: c / (n + d) if it followed
there (n observations, d distinct), else the context escapes with d / (n + d) to the next shorter one, where bytes that the
longer ones have seen are excluded from all counts. Below the empty context all bytes left are equally likely. A text ends with an
end symbol, so the probabilities of all texts sum to one; its code length is the sum over its bytes.

The trie is never broadcast. Documents are dealt into blocks of bounded size. A block asks once for the distinct contexts-with-byte and
the distinct words that occur in it, giving its training counts along. Requests that end in the same three context bytes meet in
one task, which sums up their counts, works out the probabilities and answers each request; the answers go back to the blocks,
where each scores its texts from its own slice. Heavy contexts, those of more than one in 2^14 of all training bytes, are dealt
by their fourth byte too, so no task gets all of a frequent one.

Two tables go to all tasks, both of bounded size whatever the corpus: the counts of three bytes (at most 256^3 cells) and the counts
of the byte after each heavy context (at most 2^14 * 256).

Defined results: a null or empty text has only the end token and the end symbol; a null doc_id is a training document; repeated rows are
counted and scored each, and rows of one doc_id are told apart by nothing but their text; a very long text is one entry of its block,
which needs some 40 bytes of memory a character of its longest text; with no training documents c, N and V are 0; an empty table gives
an empty table; other columns, whatever their names, are left behind.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, parts_for, text_bytes
from parcelspark.llm.rolling import Roller, word_line

ORDER = 5
#: Bytes that UTF-8 never has: what stands before a text, and its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 256
CHUNK = 1 << 20
BLOCK_BYTES = 16 << 20
#: A context of three bytes is heavy when it has more than this share of all training bytes.
HEAVY = 1 / (1 << 14)
LOW3 = (1 << 24) - 1


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ORDER bytes of context and the byte after them as one number, for each byte and end of the texts; whether the number is
    of a text (the ones between texts aren't); and where each text's start."""
    pad, end = bytes([BEFORE]) * ORDER, bytes([END])
    a = np.frombuffer(b"".join(pad + t + end for t in texts), np.uint8).astype(np.int64)
    out = np.zeros(len(a) - ORDER, np.int64)
    for i in range(ORDER + 1):
        out = (out << 8) | a[i : i + len(out)]
    lengths = np.array([len(t) + 1 + ORDER for t in texts])
    starts = np.cumsum(lengths) - lengths
    ok = np.ones(len(out) + ORDER, bool)
    for i in range(1, ORDER + 1):
        ok[starts + lengths - i] = False
    return out, ok[: len(out)], starts


def chunked(texts):
    """The texts in lists of about CHUNK characters together."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "") + ORDER + 1
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(n[order], starts) if len(k) else n


def _word_hashes(text: str | None, roller: Roller) -> np.ndarray:
    """One number a word, below 0; the numbers of contexts are 0 or more."""
    line, starts, ends = word_line(text, lower=True)
    return (roller.spans(roller.prefixes(line), starts, ends) | np.uint64(1 << 63)).view(np.int64) if len(starts) else np.zeros(0, np.int64)


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


class Tally:
    """Sums of counts by key; what has gathered is merged whenever it outgrows what is known, so it stays near the distinct keys."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, one: int) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.new.append((k, n * one))
        self.size += len(k)
        if self.size > max(1 << 18, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        self.keys, self.counts = summed([self.keys, *(k for k, _ in self.new)], [self.counts, *(n for _, n in self.new)])
        self.new, self.size = [], 0


def _requests(g: pd.DataFrame) -> pd.DataFrame:
    """key (a context with byte, or a word) and training count of all that occurs in the block."""
    roller, grams, words = Roller(), Tally(), Tally()
    for held, texts in g.groupby("held_out")["text"]:
        one = 0 if held else 1
        for some in chunked(texts):
            codes_, ok, _ = codes([_lowered(t) for t in some])
            grams.add(codes_[ok], one)
            words.add(np.concatenate([_word_hashes(t, roller) for t in some]), one)
    grams.merge()
    words.merge()
    return pd.DataFrame({"key": np.append(words.keys, grams.keys), "n": np.append(words.counts, grams.counts), "block": g["block"].iloc[0]})


class Level:
    """Contexts of one length: counts of contexts with byte, and of a context n, d and the excluded count of the level below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: "Level | None", order: int):
        seen = counts > 0
        self.keys, self.counts = keys[seen], counts[seen]
        self.contexts, starts = np.unique(self.keys >> 8, return_index=True)
        add = lambda x: np.add.reduceat(x, starts) if len(x) else x
        self.n, self.d = add(self.counts), add(np.ones(len(self.keys), np.int64))
        self.beneath = add(below.count(self.keys & ((1 << 8 * order) - 1))) if below else np.zeros(len(self.contexts), np.int64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        at, ok = position(self.keys, keys)
        return np.where(ok, self.counts[at] if len(self.counts) else 0, 0)

    def of(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ok = position(self.contexts, contexts)
        return tuple(np.where(ok, x[at] if len(x) else 0, 0) for x in (self.n, self.d, self.beneath))


def position(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, wanted), max(0, len(ordered) - 1))
    return at, (ordered[at] == wanted) if len(ordered) else np.zeros(len(wanted), bool)


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels 0, 1 and 2 from the counts of three bytes."""
    out: list[Level] = []
    for order in range(3):
        out.append(Level(*summed([keys & ((1 << 8 * (order + 1)) - 1)], [counts]), out[-1] if out else None, order))
    return out


class Model:
    """What all tasks know: the low levels, and the heavy contexts with the counts of the byte that follows."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, heavy_keys: np.ndarray, heavy_counts: np.ndarray):
        self.low = low_levels(cells, counts)
        self.heavy_keys, self.heavy_counts = heavy_keys, heavy_counts
        self.heavy = np.unique(heavy_keys >> 8)

    def is_heavy(self, contexts: np.ndarray) -> np.ndarray:
        return position(self.heavy, contexts)[1]

    def group(self, keys: np.ndarray) -> np.ndarray:
        """The number of the group a request belongs to: its last three context bytes, or four where these are heavy."""
        three = (keys >> 8) & LOW3
        out = np.where(self.is_heavy(three), (keys >> 8) & 0xFFFFFFFF | (1 << 32), three)
        return np.where(keys < 0, keys, out)

    def log_probabilities(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each byte in its context. keys: distinct, all of their groups."""
        levels = list(self.low)
        three = keys & 0xFFFFFFFF
        whole = ~self.is_heavy(three >> 8)
        asked = np.unique(three[~whole] >> 8)
        known = position(asked, self.heavy_keys >> 8)[1]
        levels.append(Level(*summed([three[whole], self.heavy_keys[known]], [counts[whole], self.heavy_counts[known]]), levels[-1], 3))
        for order in range(4, ORDER + 1):
            levels.append(Level(*summed([keys & ((1 << 8 * (order + 1)) - 1)], [counts]), levels[-1], order))
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        less_n = less_d = np.zeros(len(keys), np.int64)
        for order in range(ORDER, -1, -1):
            key = keys & ((1 << 8 * (order + 1)) - 1)
            n, d, beneath = levels[order].of(key >> 8)
            c = levels[order].count(key)
            left = np.maximum(d - less_d, 0)
            total = np.maximum(n - less_n + left, 1)
            hit = open_ & (c > 0)
            out[hit] += np.log10(c[hit] / total[hit])
            open_ &= ~hit
            passed = open_ & (left > 0)
            out[passed] += np.log10(left[passed] / total[passed])
            less_n, less_d = np.where(d > 0, beneath, 0), d
        out[open_] -= np.log10(SYMBOLS - less_d[open_])
        return out


def _four_bytes(batches):
    """Counts of a byte and the three before it, over the training documents of a task."""
    tally = Tally()
    for batch in batches:
        for some in chunked(batch["text"]):
            grams, ok, _ = codes([_lowered(t) for t in some])
            tally.add(grams[ok] & 0xFFFFFFFF, 1)
    tally.merge()
    yield pd.DataFrame({"gram": tally.keys, "n": tally.counts})


def _answers(shared):
    """Rows sorted by group and key: the answer to each request. A word's answer is its count, negative in one request a word."""

    def answered(rows: dict[str, np.ndarray]) -> pd.DataFrame:
        key = rows["key"]
        new = np.append(True, key[1:] != key[:-1])
        starts, at = np.flatnonzero(new), np.cumsum(new) - 1
        keys, counts = key[starts], np.add.reduceat(rows["n"], starts)
        value = counts.astype(float)
        grams = keys >= 0
        if grams.any():  # the levels want ascending keys
            order = np.argsort(keys[grams], kind="stable")
            logs = np.empty(len(order))
            logs[order] = shared.value.log_probabilities(keys[grams][order], counts[grams][order])
            value[grams] = logs
        value = value[at]
        return pd.DataFrame({"block": rows["block"], "key": key, "value": np.where(new & (key < 0), -value, value)})

    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        for b in batches:
            if not len(b):
                continue
            rows = {c: b[c].to_numpy() for c in ("group", "key", "n", "block")}
            if len(b) and held and rows["group"][-1] == held[0]["group"][0]:
                held.append(rows)  # still the same group
                continue
            last = int(np.searchsorted(rows["group"], rows["group"][-1]))
            if held or last:
                parts = [*held, {c: v[:last] for c, v in rows.items()}]
                yield answered({c: np.concatenate([p[c] for p in parts]) for c in rows})
            held = [{c: v[last:] for c, v in rows.items()}]
        if held:
            yield answered({c: np.concatenate([p[c] for p in held]) for c in held[0]})

    return run


class Lookup:
    """Values by key, one probe for most: a table of slots by a multiplicative hash, the sorted keys for what collides there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, 2 + int(len(keys)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = self.slots[self._slot(keys)]
        out = self.values[at]
        miss = np.flatnonzero(self.keys[at] != keys)
        out[miss] = self.values[np.searchsorted(self.keys, keys[miss])]
        return out


def _score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Sums of each document; the first row of a block also has the number of training words that this block speaks for."""
    if not len(docs):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("doc_id", "Int64"), ("held_out", bool), ("n_tokens", "int64"), ("n_known", "int64"), ("logs", float), ("score", float), ("vocabulary", "int64"))})
    key, value = (answers[c].to_numpy() for c in ("key", "value"))
    word = key < 0
    grams, words = Lookup(key[~word], value[~word]), Lookup(key[word], np.abs(value[word]))
    roller, rows = Roller(), []
    for some in chunked(docs["text"]):
        codes_, ok, starts = codes([_lowered(t) for t in some])
        logp = np.zeros(len(codes_))
        logp[ok] = grams(codes_[ok])
        for t, score in zip(some, np.add.reduceat(logp, starts), strict=True):
            c = words(_word_hashes(t, roller))
            rows.append((len(c) + 1, int((c > 0).sum()), float(np.log10(c + 1).sum()), float(score)))
    out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "logs", "score"])
    out.insert(0, "held_out", docs["held_out"].to_numpy())
    out.insert(0, "doc_id", docs["doc_id"].astype("Int64").to_numpy())
    out["vocabulary"] = 0
    out.loc[0, "vocabulary"] = int((word & (value < 0)).sum())
    return out


def train(texts: DataFrame) -> Model:
    """The tables that all tasks know, from the training texts."""
    grams = cut(texts.mapInPandas(_four_bytes, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    cells = grams.groupBy(F.col("gram").bitwiseAND(LOW3).alias("cell")).agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    context = F.call_function("shiftright", F.col("gram"), F.lit(8))
    heavy = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("_all")).where(F.col("_all") > HEAVY * float(cells["n"].sum())).select("context")
    heavy = grams.withColumn("context", context).join(F.broadcast(heavy), "context").select("gram", "n").toPandas().sort_values("gram")
    return Model(*(x[c].to_numpy().astype(np.int64) for x, c in ((cells, "cell"), (cells, "n"), (heavy, "gram"), (heavy, "n"))))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; learns from rows not held out."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = spark.sparkContext.broadcast(train(docs.where("not held_out").select("text")))

    def grouped(g: pd.DataFrame) -> pd.DataFrame:
        out = _requests(g)
        out.insert(0, "group", model.value.group(out["key"].to_numpy()))
        return out

    blocks = parts_for(spark, text_bytes(docs), BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    dealt = docs.withColumn("block", block).repartition("block")
    asked = dealt.groupBy("block").applyInPandas(grouped, "group long, key long, n int, block int")
    asked = asked.repartition("group").sortWithinPartitions("group", "key")
    answers = asked.mapInPandas(_answers(model), "block int, key long, value double")
    sums = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, vocabulary long")
    sums = cut(sums)
    train_rows = ~F.col("held_out")
    tokens, ends, words = sums.agg(F.coalesce(F.sum(F.when(train_rows, F.col("n_tokens"))), F.lit(0)), F.count(F.when(train_rows, 1)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    vocabulary = words + (1 if ends else 0)
    base = F.col("logs") + F.log10(F.lit(float(ends + 1))) - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))
    known = F.col("n_known") + F.lit(1 if ends else 0)
    return sums.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
