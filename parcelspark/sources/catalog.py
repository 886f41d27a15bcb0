"""A catalog of persisted areas: entries with the tables that belong to them, changed by commits that readers see whole or not at all.

A commit first writes its tables, by area, into a folder of its own, and then one file of log rows (upsert, delete, touch, clear). Only that file makes
it count, and it appears at once, by the rename that ends a Spark write; so a commit that fails half way leaves nothing but data that no entry names, and
readers go on with the state before. The state is the latest row of each area in the log, found by an aggregation: no row is ever
changed in place, and earlier versions can still be read until they are swept out. Many areas go into one commit, and their tables are as
large as Spark can write. Two commits of one version both count; the one with the larger id wins where they name the same area.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelspark.operators.tables import remove

c = F.col
LOG = "version long, commit string, action string, area_id string, at double, counts map<string,long>, schemas map<string,string>"


class Catalog:
    """Areas (area_id, a string, and the given columns) under a folder. at: when it happened, for expiry and eviction."""

    def __init__(self, spark: SparkSession, root: str, columns: str = "lat double, lon double, radius_m double"):
        self.spark, self.root = spark, root.rstrip("/")
        self.fields = StructType.fromDDL(columns)
        self.schema = StructType([*StructType.fromDDL(LOG), *self.fields])
        try:
            spark.read.parquet(f"{self.root}/log")
        except AnalysisException:
            self._commit(0, uuid.uuid4().hex, spark.createDataFrame([("clear", None, 0.0)], "action string, area_id string, at double"))

    # the log

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/log")

    def version(self) -> int:
        return self.log().agg(F.max("version")).first()[0]

    def _commit(self, version: int, commit: str, rows: DataFrame) -> int:
        """One file, and so all of the rows at once."""
        rows = rows.withColumn("commit", F.lit(commit))
        typed = [(c(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema if f.name != "version"]
        rows.select(*typed).coalesce(1).write.parquet(f"{self.root}/log/version={version}/commit={commit}")
        return version

    def _next(self, commit: str, rows: DataFrame) -> int:
        return self._commit(self.version() + 1, commit, rows)

    # reading

    def areas(self, version: int | None = None) -> DataFrame:
        """area_id, the catalog's columns, at, accessed (the last touch), commit, counts (rows of each table) of the areas there are."""
        log = self.log() if version is None else self.log().where(c("version") <= version)
        cleared = log.where("action = 'clear'").agg(F.max("version")).first()[0] or 0
        log = log.where((c("version") > cleared) | ((c("version") == cleared) & (c("action") != "clear")))
        order = F.struct("version", "commit")
        known = F.struct("action", "at", "commit", "counts", "schemas", *self.fields.names)
        state = log.groupBy("area_id").agg(F.max_by(known, F.when(c("action") != "touch", order)).alias("s"), F.max("at").alias("accessed"))
        return state.where("s.action = 'upsert'").select("area_id", *[c(f"s.{n}").alias(n) for n in self.fields.names], "s.at", "accessed", "s.commit", "s.counts", "s.schemas")

    def read(self, table: str, version: int | None = None, area_id: str | None = None) -> DataFrame | None:
        """The rows of a table of all areas, with their area_id, or of one area; None where there is no such area or table."""
        areas = self.areas(version)
        if area_id is not None:
            areas = areas.where(c("area_id") == area_id)
        areas = areas.where(c("schemas")[table].isNotNull()).select("area_id", "commit", c("schemas")[table].alias("schema"))
        commits = areas.groupBy("commit").agg(F.first("schema").alias("schema")).orderBy("commit").collect()  # as many as there are commits with living areas
        out = None
        for r in commits:
            schema = StructType.fromJson(json.loads(r["schema"]))
            df = self.spark.read.schema(schema).parquet(self._path(r["commit"], table)).withColumn("_commit", F.lit(r["commit"]))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            return None
        if area_id is not None:
            return out.where(c("area_id") == area_id).drop("_commit")  # a partition: other areas' files aren't opened
        return out.join(areas.select("area_id", c("commit").alias("_commit")), ["area_id", "_commit"], "left_semi").drop("_commit")

    def stats(self) -> DataFrame:
        """areas and rows of all tables."""
        rows = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
        return self.areas().agg(F.count(F.lit(1)).alias("areas"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))

    def _path(self, commit: str, table: str) -> str:
        return f"{self.root}/data/{commit}/{table}"

    # writing

    def upsert(self, entries: DataFrame, tables: dict[str, DataFrame], at: float = 0.0) -> int:
        """Adds or replaces the areas of entries (area_id and the catalog's columns) and their rows of all tables (area_id and others). A table without
        rows is kept with its columns. Returns the version."""
        commit, schemas, counts = uuid.uuid4().hex, {}, None
        for name, df in tables.items():
            path = self._path(commit, name)
            df = df.withColumn("area_id", c("area_id").cast("string"))
            df.write.partitionBy("area_id").parquet(path)
            schemas[name] = json.dumps(df.schema.jsonValue())
            n = self.spark.read.schema(df.schema).parquet(path).groupBy("area_id").agg(F.count(F.lit(1)).alias("n")).select("area_id", F.lit(name).alias("name"), "n")
            counts = n if counts is None else counts.union(n)
        rows = entries.withColumns({"area_id": c("area_id").cast("string"), "action": F.lit("upsert"), "at": F.lit(float(at))})
        none = F.create_map(*[x for name in tables for x in (F.lit(name), F.lit(0).cast("long"))])
        rows = rows.withColumn("schemas", F.create_map(*[F.lit(x) for pair in schemas.items() for x in pair]))
        if counts is not None:
            sums = counts.groupBy("area_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("_n"))  # one a table
            filled = F.map_zip_with(none, F.coalesce("_n", none), lambda k, zero, n: F.coalesce(n, zero))
            rows = rows.join(sums, "area_id", "left").withColumn("counts", filled)
        return self._next(commit, rows)

    def delete(self, areas: DataFrame) -> int:
        """Removes the areas named (area_id) and returns how many there were."""
        gone = self.areas().select("area_id").join(areas.select(c("area_id").cast("string").alias("area_id")), "area_id", "left_semi")
        n = gone.count()
        if n:
            self._next(uuid.uuid4().hex, gone.withColumn("action", F.lit("delete")))
        return n

    def touch(self, areas: DataFrame, at: float) -> None:
        """Notes that the areas were used."""
        self._next(uuid.uuid4().hex, areas.select(c("area_id").cast("string").alias("area_id"), F.lit("touch").alias("action"), F.lit(float(at)).alias("at")))

    def clear(self) -> int:
        """Removes all areas and returns how many there were."""
        n = self.areas().count()
        self._next(uuid.uuid4().hex, self.spark.createDataFrame([("clear",)], "action string"))
        return n

    def sweep(self) -> int:
        """Writes the state anew as one version and removes data and versions that it doesn't need; readers of earlier versions must have ended.
        Returns how many commits' data went."""
        state = self.areas()
        living = {r[0] for r in state.select("commit").distinct().collect()}
        before = {r[0] for r in self.log().where("schemas is not null").select("commit").distinct().collect()}
        version = self.version() + 1
        rows = state.select(F.lit("upsert").alias("action"), "*")
        kept = rows.select("action", "area_id", "at", "counts", "schemas", "commit", *self.fields.names)
        # each row goes on naming the commit that holds its data, so the file stands under its own id but keeps theirs
        typed = [c(f.name).cast(f.dataType).alias(f.name) for f in self.schema if f.name in ("action", "area_id", "at", "counts", "schemas", *self.fields.names)]
        for commit in sorted(living):
            kept.where(c("commit") == commit).select(*typed).coalesce(1).write.parquet(f"{self.root}/log/version={version}/commit={commit}")
        self._commit(version, uuid.uuid4().hex, self.spark.createDataFrame([("clear",)], "action string"))
        for v in [r[0] for r in self.log().where(c("version") < version).select("version").distinct().collect()]:
            remove(self.spark, f"{self.root}/log/version={v}")
        for commit in before - living:
            remove(self.spark, f"{self.root}/data/{commit}")
        return len(before - living)


def resume(catalog: Catalog, chunks: DataFrame, compute, at_a_time: int = 8, most: int | None = None) -> DataFrame | None:
    """compute(chunks) -> rows with their area_id, for all chunks (area_id and the catalog's columns), some at a time; each such commit is there for good, so
    a run that is stopped anywhere and called again does what is left: chunks already in the catalog fall out by an anti join, and a commit that was
    cut off doesn't count. most: how many commits this call makes at most. Returns the rows of all chunks done so far."""
    done = 0
    while most is None or done < most:
        there = catalog.areas().select(c("area_id").alias("_there"))
        todo = chunks.join(there, c("area_id").cast("string") == c("_there"), "left_anti").orderBy("area_id").limit(at_a_time)
        ids = [r[0] for r in todo.select("area_id").collect()]  # at_a_time of them
        if not ids:
            break
        some = chunks.where(c("area_id").isin(ids))
        catalog.upsert(some, {"rows": compute(some)})
        done += 1
    return catalog.read("rows")
