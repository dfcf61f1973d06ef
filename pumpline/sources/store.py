"""Tables as folders of Parquet versions: merges make the new table beside the old one, then a pointer moves.

A table `name` below the root has folders v<number>; the newest that holds a _SUCCESS marker is the table.  A
merge that breaks off leaves the old version in force.  Files are reached by Hadoop's file systems, so the root may
be any store that Spark reads.

A table of parts (`PartTable`) has a manifest instead, so that a write makes its own days or buckets only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Of stored files: half of what the default leaves of ids, which are digests.
COMPRESSION = "zstd"


@dataclass(frozen=True)
class ImportResult:
    """Rows of the input that came in, that were there already, that changed a stored one, and that were malformed."""

    inserted: int = 0
    skipped: int = 0
    updated: int = 0
    failed: int = 0

    def __add__(self, other: "ImportResult") -> "ImportResult":
        return ImportResult(self.inserted + other.inserted, self.skipped + other.skipped, self.updated + other.updated, self.failed + other.failed)


# merges, as functions of tables


def keep_existing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows, and the new ones of other keys."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def replace_matching(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All new rows, and the old ones of other keys."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti").select(*new.columns))


def merge_fields(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows by key; a new row's fields stand before the old one's, field by field."""
    fields = [*dict.fromkeys([*old.columns, *new.columns])]
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full_outer")
    side = lambda f: F.coalesce(*[F.col(f"{s}.{f}") for s, t in (("b", new), ("a", old)) if f in t.columns])
    return joined.select(*[side(f).alias(f) for f in fields])


def upsert_stations(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """New stations in place of old ones.  strict: whole, so favourites and latest prices of the old ones are lost."""
    if strict:
        return replace_matching(old, new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]), ["id"])
    own = [c for c in ("favorite", "latestPrice", "latestPrices") if c in old.columns]
    kept = old.select("id", *[F.col(c).alias(f"old_{c}") for c in own])
    rows = new.join(kept, "id", "left")
    columns = [F.coalesce(f"old_{c}", c).alias(c) if c in own and c in new.columns else F.col(f"old_{c}").alias(c) if c in own else F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    return rows.select(*columns).unionByName(old.join(new.select("id"), "id", "left_anti"))


def counted(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row: how many new rows are inserted, skipped as all their fields are there already, and updated."""
    had = old.select(*key, F.struct(*fields).alias("had")).dropDuplicates(key)
    marked = new.select(*key, F.struct(*fields).alias("has")).join(had, key, "left")
    same = F.col("had").eqNullSafe(F.col("has"))
    return marked.agg(F.count_if(F.col("had").isNull()).alias("inserted"), F.count_if(F.col("had").isNotNull() & same).alias("skipped"), F.count_if(F.col("had").isNotNull() & ~same).alias("updated"))


def result_of(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> ImportResult:
    return ImportResult(**counted(old, new, key, fields).collect()[0].asDict())


def assert_unique(rows: DataFrame, key: list[str]) -> None:
    if rows.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(key)} is no key")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """buckets: of stations; a store keeps the number that it was made with."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _versions(self, name: str) -> list[int]:
        fs, where = self._fs(f"{self.root}/{name}")
        if not fs.exists(where):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(v[1:]) for v in found if v[:1] == "v" and v[1:].isdigit() and fs.exists(self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[1]))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            if schema is None:
                raise FileNotFoundError(f"{self.root}/{name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """rows as the table's new version; the version before it stays until the next one."""
        versions = self._versions(name)
        at = (versions[-1] if versions else 0) + 1
        writer = rows.write.mode("overwrite").option("compression", COMPRESSION)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{at}")
        for old in versions[:-1]:
            self._delete(f"{self.root}/{name}/v{old}")
        return self.read(name)

    def clear(self, name: str) -> None:
        if self.exists(name):
            self.write(name, self.read(name).limit(0))

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def names(self, prefix: str = "") -> list[str]:
        """Tables whose names begin with the prefix."""
        fs, where = self._fs(self.root)
        if not fs.exists(where):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(where)) if n.startswith(prefix) and (self.exists(n) or self.by_day(n).exists()))

    def step(self, name: str) -> None:
        """Called between the steps of a write; tests break off here."""

    def by_day(self, name: str) -> "PartTable":
        """A table of rows with a column `day`, by day."""
        return PartTable(self, name, F.date_format("day", "yyyy-MM-dd"))

    def bucket(self, station: str = "station") -> Column:
        """The bucket of a station's rows."""
        return F.format_string("b%04d", F.pmod(F.xxhash64(F.col(station)), F.lit(self.buckets)))

    def by_bucket(self, name: str, station: str = "station") -> "PartTable":
        """A table by buckets of stations."""
        return PartTable(self, name, self.bucket(station))

    def bucketed(self, name: str, key: list[str], buckets: int | None = None) -> "BucketTable":
        """A table whose rows are stored by their key."""
        return BucketTable(self, name, key, buckets)

    def by_month_and_bucket(self, name: str) -> "PartTable":
        """A table of rows with columns `station` and `day`, by month and bucket of stations."""
        return PartTable(self, name, F.concat_ws("-", F.date_format("day", "yyyy-MM"), self.bucket()))


@dataclass
class Manifest:
    """What a table is after a commit: of each part the writes that hold its rows, and the commit that changed them last.

    seen: numbers of other tables' commits that this one has been made from; schema: of the newest write, as JSON.
    """

    number: int = 0
    writes: dict[str, list[str]] = field(default_factory=dict)
    changed: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    schema: str = ""

    def pairs(self) -> set[tuple[str, str]]:
        return {(w, p) for p, ws in self.writes.items() for w in ws}


class PartTable:
    """A table kept as a folder for each part - a day, a bucket of stations -, of which a write touches its own parts only.

    Rows are written to data/<write>/part=<part>; the write counts from the moment at which the manifest that names it gets its
    name, by one rename.  What breaks off before leaves the table as it was; what breaks off behind leaves files that nothing names, until
    `vacuum`.  A reader keeps its version until the next commit but one.  There is one writer at a time: of two, the later
    rename fails.  After `replace` a part's rows are those of the write, after `append` those of all its writes; a part of many
    writes is rewritten by `compact`.  Only the commits' folder, which holds two files, is listed for a read.
    """

    #: Writes of a part before `compact` makes one of them.
    MOST = 8

    def __init__(self, store: Store, name: str, part: Column):
        self.store, self.name, self.root, self.part = store, name, f"{store.root}/{name}", part

    def _numbers(self) -> list[int]:
        fs, where = self.store._fs(f"{self.root}/commits")
        if not fs.exists(where):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in found if n[:1] == "m" and n[1:].isdigit())

    def _manifest(self, number: int) -> Manifest:
        fs, where = self.store._fs(f"{self.root}/commits/m{number}")
        jvm = self.store.spark.sparkContext._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(where), "UTF-8"))
        try:
            return Manifest(**json.loads(reader.readLine()))
        finally:
            reader.close()

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else Manifest()

    def exists(self) -> bool:
        return bool(self._numbers())

    def parts(self) -> list[str]:
        return sorted(self.manifest().writes)

    def changed_since(self, number: int) -> list[str]:
        """Parts that were written after a commit."""
        return sorted(p for p, n in self.manifest().changed.items() if n > number)

    def read(self, parts: list[str] | None = None, schema: str | None = None) -> DataFrame:
        """The rows of all or of the given parts; schema: of a table that was never written."""
        now = self.manifest()
        chosen = now.writes if parts is None else [p for p in dict.fromkeys(parts) if p in now.writes]
        paths = [f"{self.root}/data/{w}/part={p}" for p in chosen for w in now.writes[p]]
        if not now.schema and schema is None:
            raise FileNotFoundError(self.root)
        kind = StructType.fromJson(json.loads(now.schema)) if now.schema else schema
        return self.store.spark.read.schema(kind).parquet(*paths) if paths else self.store.spark.createDataFrame([], kind)

    def append(self, rows: DataFrame, finish=None) -> list[str]:
        """Rows beside those that are there; the parts that were written.

        finish: makes the table's rows of the given ones, which are dealt to their parts before; it keeps the column `part`.
        """
        old = self.manifest()
        write, parts, schema = self._written(rows, old, finish)
        if parts or not old.schema:
            writes = old.writes | {p: [*old.writes.get(p, []), write] for p in parts}
            self._commit(old, Manifest(old.number + 1, writes, old.changed | dict.fromkeys(parts, old.number + 1), old.seen, schema))
        return parts

    def replace(self, rows: DataFrame, of: list[str] | None = None, seen: dict[str, int] | None = None, finish=None, dealt: bool = False) -> list[str]:
        """Rows in place of all rows of their parts, and of the parts `of`, which go if they have no rows; the parts that changed.

        finish: as in `append`; dealt: rows lie in tasks by their parts already.
        """
        old = self.manifest()
        write, parts, schema = self._written(rows, old, finish, dealt)
        touched = [*dict.fromkeys([*parts, *(p for p in of or [] if p in old.writes)])]
        if touched or not old.schema or (seen and old.seen | seen != old.seen):
            writes = {p: ws for p, ws in old.writes.items() if p not in set(touched)} | {p: [write] for p in parts}
            changed = {p: n for p, n in old.changed.items() if p in writes} | dict.fromkeys(parts, old.number + 1)
            self._commit(old, Manifest(old.number + 1, writes, changed, old.seen | (seen or {}), schema))
        return touched

    def merge(self, new: DataFrame, parts: list[str], key: list[str]) -> list[str]:
        """New rows in place of those of their key, in the given parts, which are all that new rows have; other rows stay.

        Stored and new rows move once, to tasks of which each has a share of a part's keys and writes it.
        """
        old = self.read(parts, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields))
        both = new.withColumn("is_new", F.lit(True)).unionByName(old.select(*new.columns).withColumn("is_new", F.lit(False)))
        shares = max(1, int(self.store.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(parts)))
        at = ["part", "share"]
        both = both.withColumn("part", self.part).withColumn("share", F.pmod(F.hash(*key), F.lit(shares))).repartition(*at)
        first = Window.partitionBy(*at, *key).orderBy(F.desc("is_new"))
        return self.replace(both.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*new.columns), dealt=True)

    def compact(self, most: int | None = None) -> list[str]:
        """Makes one write of the parts that have more than `most`; their rows don't count as changed."""
        old = self.manifest()
        many = [p for p, ws in old.writes.items() if len(ws) > (most or self.MOST)]
        if many:
            write, parts, _ = self._written(self.read(many), old)
            self._commit(old, Manifest(old.number + 1, old.writes | {p: [write] for p in parts}, old.changed, old.seen, old.schema))
        return many

    def clear(self) -> None:
        old = self.manifest()
        if old.writes:
            self._commit(old, Manifest(old.number + 1, schema=old.schema))

    def vacuum(self) -> int:
        """Deletes what no manifest names: the remains of what broke off.  Not beside a writer.  How many folders went."""
        named = {pair for n in self._numbers() for pair in self._manifest(n).pairs()}
        fs, where = self.store._fs(f"{self.root}/data")
        gone = 0
        for write in fs.listStatus(where) if fs.exists(where) else []:
            name = write.getPath().getName()
            inside = [x.getPath().getName().removeprefix("part=") for x in fs.listStatus(write.getPath()) if x.isDirectory()]
            kept = [p for p in inside if (name, p) in named]
            for path in [f"{self.root}/data/{name}"] if not kept else [f"{self.root}/data/{name}/part={p}" for p in set(inside) - set(kept)]:
                self.store._delete(path)
                gone += 1
        return gone

    def _written(self, rows: DataFrame, old: Manifest, finish=None, dealt: bool = False) -> tuple[str, list[str], str]:
        write = f"w{old.number + 1}-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/data/{write}"
        # Few files a part, and a large part in several: the rebalance splits by size.
        rows = rows.withColumn("part", self.part)
        rows = rows if dealt else rows.hint("rebalance", F.col("part"))
        rows = finish(rows) if finish else rows
        rows.write.partitionBy("part").option("compression", COMPRESSION).parquet(path)
        fs, where = self.store._fs(path)
        self.store.step(f"{self.name} written")
        return write, [s.getPath().getName().removeprefix("part=") for s in fs.listStatus(where) if s.isDirectory()], rows.drop("part").schema.json()

    def _commit(self, old: Manifest, new: Manifest) -> None:
        final, draft = f"{self.root}/commits/m{new.number}", f"{self.root}/commits/draft-{uuid.uuid4().hex}"
        fs, at = self.store._fs(draft)
        out = fs.create(at)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        _, to = self.store._fs(final)
        if fs.exists(to) or not fs.rename(at, to):
            self.store._delete(draft)
            raise RuntimeError(f"{final} is there already: another writer was faster")
        self.store.step(f"{self.name} committed")
        for number in [n for n in self._numbers() if n < old.number]:
            before = self._manifest(number)
            for write, part in before.pairs() - old.pairs() - new.pairs():
                self.store._delete(f"{self.root}/data/{write}/part={part}")
            left = {w for w, _ in old.pairs() | new.pairs()}
            for write in {w for w, _ in before.pairs()} - left:
                self.store._delete(f"{self.root}/data/{write}")
            self.store._delete(f"{self.root}/commits/m{number}")
        self.store.step(f"{self.name} cleaned")


class BucketTable:
    """A table bucketed and sorted by its key, in versions: a merge exchanges the new rows only, the stored ones stay where they are.

    A version is a folder of Parquet files, one or more for each bucket; it counts from its _SUCCESS on.  The bucketing is told to the session's
    catalog, under a name that the folder gives, so a new session knows it as well.
    """

    def __init__(self, store: Store, name: str, key: list[str], buckets: int | None = None):
        self.store, self.name, self.key, self.buckets = store, name, key, buckets or store.buckets

    def _path(self, version: int) -> str:
        return f"{self.store.root}/{self.name}/v{version}"

    def _table(self, version: int) -> str:
        return f"pumpline_{hashlib.sha256(self._path(version).encode()).hexdigest()[:24]}"

    def exists(self) -> bool:
        return self.store.exists(self.name)

    def read(self) -> DataFrame:
        versions = self.store._versions(self.name)
        if not versions:
            raise FileNotFoundError(f"{self.store.root}/{self.name}")
        spark, table = self.store.spark, self._table(versions[-1])
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(self._path(versions[-1])).schema.fields)
            key = ", ".join(f"`{k}`" for k in self.key)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self._path(versions[-1])}'")
        return spark.table(table)

    def write(self, rows: DataFrame) -> DataFrame:
        """Rows as the new version; the one before it stays until the next."""
        versions = self.store._versions(self.name)
        at = (versions[-1] if versions else 0) + 1
        self.store._delete(self._path(at))
        # A task for each bucket writes one file.
        dealt = rows.repartition(self.buckets, *self.key)
        dealt.write.bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", self._path(at)).format("parquet").saveAsTable(self._table(at))
        for old in versions[:-1]:
            self.store.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
            self.store._delete(self._path(old))
        return self.read()
