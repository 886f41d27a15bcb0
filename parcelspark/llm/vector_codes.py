"""Vector code compression: a codebook for each of several parts of a vector, trained in whole numbers.

Components become integers, floor(scale * x), and travel as blocks: one NumPy array of dimensions by vectors for each Arrow batch, so a
dimension lies together in memory. The blocks are written to the shared folder once; every round reads them from there, so a lost executor
costs one read. A round is one RDD treeAggregate: each task assigns its blocks (squared distances to all entries accumulate
dimension by dimension in int64) and adds them to tensors of sums and counts with np.add.at; the tensors, of a fixed size (parts x entries x
dimensions of a part), merge through a tree of tasks. Nothing is sampled, and sums of integers don't depend on the order of merging, so any
number of tasks gives the same codebooks. Assignment is map-only; the error by label is summed on the map side and joined back.

Defined results: vectors that are null, hold null or non-finite components, or have a component of 2^16 or more (whose squared distances no
long could hold) are dropped; so are those whose length isn't that of the first vector, by vec_id, whose length is a positive multiple
of `parts`; null vec_ids come after all others, and rows with the same vec_id are separate vectors, in the order of their components; with
fewer vectors than entries there are as many entries as vectors; distances that tie go to the lower entry; null labels are one label;
an empty table gives an empty table; other columns, whatever their names, are left behind.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import shared_path

LAST = (1 << 63) - 1
LIMIT = float(1 << 16)
CODES = "vec_id long, label {label}, code string, error long"


def usable(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """_id, label, vector of the rows that can be coded, and their length (0: there are none)."""
    rows = vectors.select(F.coalesce("vec_id", F.lit(LAST)).cast("long").alias("_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < LIMIT)))  # NaN is larger than any number
    rows = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = rows.orderBy("_id", "vector").select(F.size("vector").alias("n")).first()
    length = first["n"] if first else 0
    return rows.where(F.size("vector") == length), length


def whole_numbers(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """Dimensions by vectors."""
    flat = np.asarray(column.flatten(), np.float64)
    return np.ascontiguousarray(np.floor(flat * scale).astype(np.int64).reshape(-1, length).T)


def _blocks(length: int, scale: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data = whole_numbers(batch.column("vector"), length, scale).astype(np.int32)  # below 2^16 times 2^12
                yield pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary())], ["block"])

    return run


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """block: dimensions x vectors; books: parts x entries x dimensions of a part. The nearest entry of each part and vector, and its squared distance."""
    parts, entries, width = books.shape
    codes, errors = np.zeros((parts, block.shape[1]), np.int64), np.zeros((parts, block.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for j in range(width):
            step = block[p * width + j][None, :] - books[p, :, j][:, None]
            far += step * step
        codes[p] = far.argmin(axis=0)
        errors[p] = far[codes[p], np.arange(block.shape[1])]
    return codes, errors


def add(tensors: tuple, block: np.ndarray, books: np.ndarray) -> tuple:
    sums, counts = tensors
    codes, _ = assign(block, books)
    width = books.shape[2]
    for p in range(len(books)):
        np.add.at(sums[p], codes[p], block[p * width : (p + 1) * width].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def merge(a: tuple, b: tuple) -> tuple:
    a[0].__iadd__(b[0])
    a[1].__iadd__(b[1])
    return a


def train(rows: DataFrame, length: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks, parts x entries x dimensions of a part, of what usable() returns."""
    spark = rows.sparkSession
    start = rows.orderBy("_id", "vector").limit(entries).select("vector").toArrow().column("vector").combine_chunks()
    books = np.ascontiguousarray(whole_numbers(start, length, scale).reshape(parts, length // parts, -1).transpose(0, 2, 1))
    path = shared_path(spark, "vector-blocks")
    rows.select("vector").mapInArrow(_blocks(length, scale), "block binary").write.parquet(path)
    blocks = spark.read.parquet(path).rdd.map(lambda r: np.frombuffer(r["block"], np.int32).reshape(length, -1).astype(np.int64))
    for _ in range(rounds):
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = blocks.treeAggregate(zero, lambda t, b, books=books: add(t, b, books), merge, depth=3)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def _coded(books: np.ndarray, length: int, scale: int):
    def run(batches):
        digits = np.array([f"{k:02x}" for k in range(256)], object)
        for batch in batches:
            codes, errors = assign(whole_numbers(batch.column("vector"), length, scale), books)
            text = digits[codes].sum(axis=0) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each usable row of vectors (vec_id, embedding, label)."""
    if not (1 <= entries <= 256 and parts >= 1 and 1 <= scale <= 4096):
        raise ValueError("an entry has two hexadecimal digits, and scale is at most 4096")
    rows, length = usable(vectors, parts)
    label = dict(rows.dtypes)["label"]
    if not length:
        return rows.sparkSession.createDataFrame([], f"{CODES.format(label=label)}, label_error long, codebooks_sha256 string")
    books = train(rows, length, parts, entries, rounds, scale)
    coded = rows.mapInArrow(_coded(books, length, scale), CODES.format(label=label))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
