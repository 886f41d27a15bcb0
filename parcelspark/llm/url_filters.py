"""URL filters: allow and block rules of host and path, held in sorted arrays of digests.

A rule fits its host and all subdomains where the url's path starts with the rule's. Rules are stored in shards by their host's digest, a file
each, made by Spark tasks and written by Spark's writer to the shared folder. A file holds two arrays, each sorted by 64-bit xxhash: the hosts
that have rules, with the lengths of their paths, and the rules. Beside the digests stand the full strings. Files reach the executors by
addFile, once each, and are memory-mapped: tasks share the pages they touch, so an index may be larger than memory.

A task takes the distinct hosts of a batch, probes their suffixes (no more labels than the deepest rule has) in the host array by
vectorised binary search, and then, for the hosts found, the host, a slash and the path cut to each of the host's lengths in the rule array. Every hit is
confirmed against the stored string; where another string has the same digest, the search goes on to the next equal digest. Pages aren't shuffled.

The longest rule (bytes of host and path together, then of the host) decides; where none fits, `default` does. A list of rules says
nothing about what it doesn't list, so that is allow.

Defined results: a null url, or one without ://, has an empty host and path, which no rule fits; a rule without host, with one of the
signs / ? # in it, or with a verdict other than allow and block is ignored, null paths are empty, A-Z of rule hosts are lower-cased, and where two equal rules disagree block wins; very long
urls are judged whole; repeated rows are judged alike; without rules the default holds for all; an empty table gives an empty table; other columns are carried
along, and those named host, path, rule or verdict are replaced.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import ascii_lower, shared_path

#: Spark's xxhash64 starts from this seed.
SEED = 42
#: Magic number, hosts, bytes of hosts, path lengths, rules, bytes of rules, labels of the deepest host, nothing.
HEAD = "<8q"
MAGIC = 0x5552_4C46_494C_54
VERDICTS = ["block", "allow"]
JUDGED = "rule string, verdict string"


def digests(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys)).view(np.int64)


class DigestArray:
    """Sorted digests with the strings they stand for; a number goes with each."""

    def __init__(self, digest: np.ndarray, ends: np.ndarray, values: np.ndarray, blob: np.ndarray):
        self.digest, self.ends, self.values, self.blob = digest, ends, values, blob

    @classmethod
    def build(cls, keys: list[bytes], values: list[int], digest: np.ndarray | None = None) -> "DigestArray":
        digest = digests(keys) if digest is None else digest
        order = np.argsort(digest, kind="stable")
        ends = np.cumsum([0, *(len(keys[i]) for i in order)], dtype=np.int64)
        return cls(digest[order], ends, np.array(values, np.int64)[order], np.frombuffer(b"".join(keys[i] for i in order), np.uint8))

    def key(self, at: int) -> bytes:
        return self.blob[self.ends[at] : self.ends[at + 1]].tobytes()

    def find(self, keys: list[bytes], digest: np.ndarray | None = None) -> np.ndarray:
        """The place of each key, or -1."""
        digest = digests(keys) if digest is None else digest
        out, at, todo = np.full(len(keys), -1), np.searchsorted(self.digest, digest), np.arange(len(keys))
        while len(todo):
            todo = todo[at[todo] < len(self.digest)]
            todo = todo[self.digest[at[todo]] == digest[todo]]
            same = np.array([self.key(at[i]) == keys[i] for i in todo], bool)
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.digest, self.ends, self.values]


class Shard:
    """The hosts of a shard with the lengths of their paths, longest first, and its rules."""

    def __init__(self, hosts: DigestArray, lengths: np.ndarray, rules: DigestArray, deepest: int):
        self.hosts, self.lengths, self.rules, self.deepest = hosts, lengths, rules, deepest

    @classmethod
    def build(cls, rules: pd.DataFrame) -> "Shard":
        host, path = ([x.encode() for x in rules[c]] for c in ("host", "path"))
        of: dict[bytes, set[int]] = {}
        for h, p in zip(host, path, strict=True):
            of.setdefault(h, set()).add(len(p))
        names, lengths, at = list(of), [], []
        for h in names:
            at.append(len(lengths) << 32 | len(of[h]))
            lengths += sorted(of[h], reverse=True)
        verdict = [VERDICTS.index(v) for v in rules["verdict"]]
        deepest = max((h.count(b".") + 1 for h in names), default=0)
        return cls(DigestArray.build(names, at), np.array(lengths, np.int64), DigestArray.build([h + b"/" + p for h, p in zip(host, path, strict=True)], verdict), deepest)

    def dump(self) -> bytes:
        """Numbers first, so that they stand at multiples of eight bytes."""
        head = struct.pack(HEAD, MAGIC, len(self.hosts.digest), len(self.hosts.blob), len(self.lengths), len(self.rules.digest), len(self.rules.blob), self.deepest, 0)
        numbers = [*self.hosts.arrays(), self.lengths, *self.rules.arrays()]
        return b"".join([head, *(x.astype("<i8").tobytes() for x in numbers), self.hosts.blob.tobytes(), self.rules.blob.tobytes()])

    @classmethod
    def map(cls, path: str) -> "Shard":
        data = np.memmap(path, np.uint8, mode="r")
        magic, hosts, host_bytes, lengths, rules, rule_bytes, deepest, _ = struct.unpack(HEAD, data[: struct.calcsize(HEAD)].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} holds no rules")
        sizes = [8 * n for n in (hosts, hosts + 1, hosts, lengths, rules, rules + 1, rules)] + [host_bytes, rule_bytes]
        ends = struct.calcsize(HEAD) + np.cumsum([0, *sizes])
        x = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n = [y.view("<i8") for y in x[:7]]
        return cls(DigestArray(*n[:3], x[7]), n[3], DigestArray(*n[4:7], x[8]), deepest)


def suffixes(host: bytes, deepest: int) -> list[bytes]:
    """The host and what is left without its first labels, longest first, of at most so many labels."""
    labels = host.rsplit(b".", deepest)[-deepest:] if deepest else []
    return [b".".join(labels[i:]) for i in range(len(labels))]


def judge_batch(shards: list[Shard], hosts: pd.Series, paths: pd.Series, default: str) -> pd.DataFrame:
    """rule and verdict of each row."""
    deepest = max((s.deepest for s in shards), default=0)
    codes, names = pd.factorize(hosts)
    probes = [(k, x) for k, h in enumerate(names) for x in suffixes(h.encode(), deepest)]
    keys = [x for _, x in probes]
    digest = digests(keys)
    home = digest % len(shards) if shards else digest
    fits: list[list] = [[] for _ in names]  # of each host: shard, suffix, lengths of paths
    for n, shard in enumerate(shards):
        mine = np.flatnonzero(home == n)
        for i, at in zip(mine, shard.hosts.find([keys[i] for i in mine], digest[mine]), strict=True):
            if at >= 0:
                start, count = divmod(int(shard.hosts.values[at]), 1 << 32)
                fits[probes[i][0]].append((n, keys[i], shard.lengths[start : start + count].tolist()))
    rows: list[list] = [[] for _ in shards]
    for i, (k, path) in enumerate(zip(codes, paths, strict=True)):
        if fits[k]:
            path = path.encode()
            for n, host, lengths in fits[k]:
                rows[n] += [(i, len(host), host + b"/" + path[:cut]) for cut in lengths if cut <= len(path)]
    best: dict[int, tuple] = {}
    for shard, asked in zip(shards, rows, strict=True):
        for (i, host, key), at in zip(asked, shard.rules.find([key for _, _, key in asked]), strict=True):
            if at >= 0:
                best[i] = max(best.get(i, (0, 0, b"", 0)), (len(key), host, key, int(shard.rules.values[at])))
    rule, verdict = [None] * len(codes), [default] * len(codes)
    for i, (_, host, key, value) in best.items():
        rule[i], verdict[i] = (key[:host] + key[host + 1 :]).decode(), VERDICTS[value]
    return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})


def _dumped(batches):
    """One file a task, for all rules of its shard, or none for a shard without rules."""
    found = [b for b in batches if len(b)]
    if found:
        yield pd.DataFrame({"file": [Shard.build(pd.concat(found, ignore_index=True)).dump()]})


def build_index(rules: DataFrame, shard_bytes: int = 64 << 20) -> tuple[list[str | None], str]:
    """Writes the rules (host, path, verdict) as shards of about shard_bytes of strings to the shared folder, and adds the files to the session.
    Returns their names, in the order of the shards, and the folder."""
    spark = rules.sparkSession
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where((F.length("host") > 0) & ~F.col("host").rlike("[/?#]") & F.col("verdict").isin(VERDICTS)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = rules.agg(F.coalesce(F.sum(2 * F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()[0]
    n = max(1, -(-size // shard_bytes))
    shards = rules.repartitionById(n, F.pmod(F.xxhash64("host"), F.lit(n)).cast("int"))
    path = shared_path(spark, "url-rules")
    shards.mapInPandas(_dumped, "file binary").select(F.col("file").cast("string").alias("value")).write.text(path)
    names: list[str | None] = [None] * n
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard")).collect():
        spark.sparkContext.addFile(r["path"])
        names[r["shard"]] = r["path"].rsplit("/", 1)[-1]
    return names, path


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the one that decides, else null) and verdict."""
    names, _ = build_index(rules)
    empty = Shard.build(pd.DataFrame({"host": [], "path": [], "verdict": []}))

    @F.pandas_udf(JUDGED)
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        shards = [Shard.map(SparkFiles.get(name)) if name else empty for name in names]
        for hosts, paths in batches:
            yield judge_batch(shards, hosts, paths, default)

    parts = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    names_made = ("host", "path", "rule", "verdict")
    out = pages.select("*", ascii_lower(parts[0]).alias("_url_host"), parts[1].alias("_url_path")).drop(*names_made)
    out = out.withColumn("_url_judged", verdicts("_url_host", "_url_path"))
    made = [F.col("_url_host").alias("host"), F.col("_url_path").alias("path"), F.col("_url_judged.rule").alias("rule"), F.col("_url_judged.verdict").alias("verdict")]
    return out.select(*[c for c in pages.columns if c not in names_made], *made)
