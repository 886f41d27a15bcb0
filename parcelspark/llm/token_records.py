"""Token ids as length-delimited binary records with a separate offset index.

A record is

    u64 length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | newline

and a payload is i64 doc_id | u8 (1: doc_id is null) | u8 bytes an id (2 or 4) | u32 count | count x ids, all little-endian. Ids
take two bytes where the whole vocabulary fits, else four. The masking rotates a checksum right by 15 bits and adds a constant,
so that data which hold checksums of their own don't verify by accident. The final newline is Spark's own record end: the frames
are written by Spark's writer, so tasks commit whole files, a lost executor leaves none behind, and any store that Spark can
write to will do.

Documents are range-partitioned by doc_id and a hash of the text, so file order and order within a file give the ascending order of
the whole; a file holds about `shard_bytes` of text, also where many rows have the same doc_id or none. The index is made by reading
the files back and checking every checksum; it has a row for each record with file, offset and length. Shuffled reads look
records up by offset: a file is read once, and only the wanted records are taken out of it.

Whole texts are encoded. With most tokenizers a text's ids are those of its chunks between ASCII white space, one after another: then each
task encodes a distinct chunk once and keeps it, within a bound in bytes. Whether that holds for the given tokenizer is
found out before, on every pair of a set of characters beside each other and across white space (`splits`), and checked again on
one text in CHECKED of each batch, which goes to the tokenizer whole. Words of plain letters go to the tokenizer's model itself where a probe shows
that its other parts leave them as they are (`plain_letters`), and signs at the end of a word are encoded by themselves. Tokenizers for which it doesn't hold get all texts whole, in
batches of bounded size. The definition of the tokenizer travels to the tasks by broadcast; it has the size of its vocabulary, which
is checked.

Defined results: a null or empty text has only the end id; null doc_ids come first; rows with the same doc_id are separate
records, in the order of a 64-bit hash of their text; a very long text is one record, so a task needs memory for its longest text; an empty table gives an empty index; other columns, whatever
their names, are left behind.
"""

import os
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import give_back, parts_for, released, text_bytes

MASK = 0xA282EAD8
HOLDS, HOLDS_SIZE = "<qBBI", struct.calcsize("<qBBI")
END_ID = 1
#: Characters that go to the tokenizer at a time (a longer text goes alone), and the largest tokenizer definition that is broadcast.
TOGETHER = 1 << 18
MOST_DEFINITION = 256 << 20
#: Bytes of chunks and ids that a task keeps, what an entry takes beside them, and how seldom a text is encoded in both ways.
KEPT, ENTRY, CHECKED = 96 << 20, 150, 1000
#: Signs that are taken off the end of a chunk.
TAIL = b".,!?;:#$%&*"
#: Characters that byte-level models have for bytes from 128 without a sign of their own.
BYTES = {**{b: b + 162 for b in range(128, 161)}, 173: 323}
#: What stands between chunks that are encoded together: a character that is one id by itself.
MARK = "|"
INDEX = "shard int, path string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 2) -> bytes:
    payload = struct.pack(HOLDS, doc_id or 0, doc_id is None, width, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def record(data: bytes, at: int):
    """Payload length, doc_id and ids of the record at a byte; raises where a checksum fails."""
    length, crc = struct.unpack_from("<QI", data, at)
    payload = data[at + 12 : at + 12 + length]
    if crc != masked(data[at : at + 8]) or struct.unpack_from("<I", data, at + 12 + length)[0] != masked(payload):
        raise ValueError(f"corrupt record at byte {at}")
    doc_id, none, width, n = struct.unpack_from(HOLDS, payload)
    return length, None if none else doc_id, np.frombuffer(payload, f"<u{width}", n, HOLDS_SIZE)


def records(data: bytes):
    """Offset, payload length, doc_id and ids of each record."""
    at = 0
    while at < len(data):
        length, doc_id, ids = record(data, at)
        yield at, length, doc_id, ids
        at += 12 + length + 4 + 1


def together(texts: list[str]):
    """The texts in lists of about TOGETHER characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def chunks(text: str) -> list[bytes]:
    """The text between ASCII white space. A-Z are lower-cased, but not where special tokens, which know case, may stand."""
    data = text.encode()
    return data.split() if b"<|" in data else data.lower().split()


def stem(chunk: bytes, plain=None) -> bytes | None:
    """The chunk without the signs at its end (TAIL), where they follow an ASCII letter or digit, or a word that plain knows, and so are a piece by themselves."""
    out = chunk.rstrip(TAIL)
    return out if out and len(out) < len(chunk) and (out[-1:].isalnum() or plain and plain(out.decode())) else None


def whole(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def plain_letters(tokenizer) -> str:
    """Small Latin letters of which words reach the tokenizer's model as one piece of byte characters (BYTES), otherwise unchanged: each is tried alone, doubled
    and beside every other. None of them if any pair fails."""
    if any(t.content.strip().isalpha() for t in tokenizer.get_added_tokens_decoder().values()):
        return ""
    small = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
    words = [*small, *[a + b for a in small for b in small], *[a + b * 2 + a for a in small for b in "aez\xe9"], "".join(small), "".join(small[::-1]) * 9]
    same = [[t.id for t in tokenizer.model.tokenize(as_bytes(w.encode()))] for w in words] == whole(tokenizer, words)
    return "".join(small) if same else ""


def as_bytes(word: bytes) -> str:
    return word.decode() if word.isascii() else word.decode("latin-1").translate(BYTES)


class ChunkEncoder:
    """Ids of texts, chunk by chunk; known ones are kept."""

    def __init__(self, tokenizer, kind: str, kept: int = KEPT):
        self.tokenizer, self.kind, self.kept = tokenizer, kind, kept
        self.known: dict[bytes, bytes] = {}
        self.size = 0
        (self.mark,) = tokenizer.encode(MARK, add_special_tokens=False).ids
        letters = plain_letters(tokenizer)
        self.plain = re.compile(f"[{letters}]+").fullmatch if letters else None

    def _cut(self, ids: list[int], ends: list[int], gap: int) -> list[bytes]:
        """The ids between ends, gap ids being left out after each."""
        raw = np.array(ids, self.kind).tobytes()
        wide = len(raw) // max(len(ids), 1)
        return [raw[wide * a : wide * b] for a, b in zip([0, *[e + gap for e in ends]], ends, strict=False)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of plain letters, from the model itself."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], []
        for w in words:
            ids += [t.id for t in tokenize(as_bytes(w))]
            ends.append(len(ids))
        return self._cut(ids, ends, 0)

    def _marked(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without MARK, which go to the tokenizer as one text with MARK between them."""
        (ids,) = whole(self.tokenizer, [f" {MARK} ".join(map(bytes.decode, words))])
        ends = [*np.flatnonzero(np.array(ids) == self.mark).tolist(), len(ids)]
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't keep chunks apart")
        return self._cut(ids, ends, 1)

    def _alone(self, words: list[bytes]) -> list[bytes]:
        return [np.array(x, self.kind).tobytes() for x in whole(self.tokenizer, list(map(bytes.decode, words)))]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, mark = {}, MARK.encode()
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            small = [w for w in some if self.plain(w.decode())] if self.plain else []
            odd = [w for w in some if mark in w]
            rest = list(set(some).difference(small, odd))
            for kind, way in ((small, self._letters), (odd, self._alone), (rest, self._marked)):
                if kind:
                    out.update(zip(kind, way(kind), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.size > self.kept:
            self.known.clear()
            self.size = 0
        known, split = self.known, [chunks(t) for t in texts]
        stems = {w: stem(w, self.plain) for w in set().union(*split).difference(known)}
        ended = [(w, s, w[len(s) :]) for w, s in stems.items() if s]
        new = {w for w, s in stems.items() if not s}.union([s for _, s, _ in ended], [e for _, _, e in ended])
        known.update(self._encode(list(new.difference(known))))
        known.update([(w, known[s] + known[e]) for w, s, e in ended])
        self.size += sum(map(len, stems)) + sum(map(len, map(known.__getitem__, stems))) + ENTRY * len(stems)
        return [b"".join(map(known.__getitem__, words)) for words in split]


def splits(tokenizer) -> bool:
    """Whether texts may be encoded chunk by chunk: tried on every pair of printable ASCII characters and some others."""
    if len(tokenizer.encode(MARK, add_special_tokens=False).ids) != 1:
        return False
    characters = [chr(c) for c in range(33, 127)] + list("\x00\x1f\x85\xa0\xad\xc9\xe9\xdf\u0130\u0301\u0430\u05d0\u0661\u0e01\u200b\u2003\u3000\u4e2d\uac00\uff21\U0001f600")
    spaces = [" ", "\n", "\t", "\r\n", "  ", "\x0b", "\x0c", " \n "]
    texts = []
    for i, a in enumerate(characters):
        texts.append("".join(f"{x}{spaces[(i + j) % len(spaces)]}{y}" for j, b in enumerate(characters) for x, y in ((a, b), (f"Ab{a}{b}", f"{a}{b}cD"), (f"{a}12", f"{b}Ef."))))
    texts += [f"{s}a{s}B.{s}" for s in spaces] + ["", " ", "<|endoftext|> A<|x|>B |a| it's IT'S 'Ll"]
    try:
        ids = ChunkEncoder(tokenizer, "<u4")(texts)
    except ValueError:
        return False
    return [np.frombuffer(x, "<u4").tolist() for x in ids] == whole(tokenizer, texts)


def _encoder(shared, end_id: int, by_chunk: bool, kept: int = KEPT):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        # names of the task alone: the package travels by value, so what its globals hold would outlive the task until the worker collects cycles
        tokenizer = Tokenizer.from_str(shared.value)
        width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kind = f"<u{width}"
        encode = ChunkEncoder(tokenizer, kind, kept) if by_chunk else None
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            docs = zip(batch["doc_id"].tolist(), batch["doc_id"].isna().tolist(), strict=True)
            given = [t or "" for t in batch["text"]]
            if by_chunk and given:
                some = given[::CHECKED]
                if encode(some) != [np.array(x, kind).tobytes() for x in whole(tokenizer, some)]:
                    raise ValueError("the tokenizer doesn't encode chunk by chunk")
            for texts in together(given):
                ids = encode(texts) if by_chunk else [np.array(x, kind).tobytes() for x in whole(tokenizer, texts)]
                yield pd.DataFrame({"frame": [frame(None if none else int(d), x + end, width) for x, (d, none) in zip(ids, docs, strict=False)]})

    return run


def _parse(batches):
    for batch in batches:
        for shard, path, data in zip(batch["shard"], batch["path"], batch["content"], strict=True):
            rows, before = [], 0
            for at, length, doc_id, ids in records(data):
                rows.append((shard, path, at, length, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                before += len(ids)
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
            yield out.astype({"doc_id": "Int64"})


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "content")


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = 32 << 20, kept: int = KEPT) -> DataFrame:
    """Writes path/records and path/index and returns the index. tokenizer: the file of its definition, read by the driver. kept: bytes of chunks and ids
    that a task keeps; less of it and of shard_bytes, which a task reads back whole, is slower and takes less memory."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    definition = Path(tokenizer).read_text(encoding="utf-8")
    if len(definition) > MOST_DEFINITION:
        raise ValueError(f"the tokenizer's definition has {len(definition)} characters, more than {MOST_DEFINITION} to broadcast")
    by_chunk = splits(Tokenizer.from_str(definition))
    give_back()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_for(spark, text_bytes(docs), shard_bytes)
    order = "doc_id", F.xxhash64("text")
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    frames = ordered.mapInPandas(released(_encoder(spark.sparkContext.broadcast(definition), end_id, by_chunk, kept)), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.text(f"{path}/records")
    _files(spark, path).mapInPandas(released(_parse), INDEX).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def offsets(index: DataFrame) -> DataFrame:
    """The index with start, the number of ids in all records before: sums over files, then within the file."""
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return index.join(files, "shard").withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def _wanted(batches):
    """The records of a file that stand at the wanted offsets."""
    for batch in batches:
        for shard, data, wanted in zip(batch["shard"], batch["content"], batch["wanted"], strict=True):
            found = [record(data, int(at))[1:] for at in wanted]
            yield pd.DataFrame({"at": wanted, "doc_id": pd.array([d for d, _ in found], "Int64"), "ids": [x.astype(np.int64) for _, x in found], "shard": shard})


def read_records(spark: SparkSession, path: str, seed: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """doc_id and ids of each record of the index (default: all, or any part of it), by offset; with a seed in an order that it
    shuffles."""
    index = spark.read.parquet(f"{path}/index") if index is None else index
    wanted = index.groupBy("shard").agg(F.collect_list("offset").alias("wanted"))  # as many as one file holds
    found = _files(spark, path).join(wanted, "shard").select("shard", "content", "wanted").mapInPandas(_wanted, "at long, doc_id long, ids array<long>, shard int")
    found = found.orderBy(F.xxhash64("shard", "at", F.lit(seed))) if seed is not None else found
    return found.select("doc_id", "ids")
