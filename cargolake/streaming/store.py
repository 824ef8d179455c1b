"""Versioned table snapshots in buckets, with a ledger of applied batches.

A store holds named tables, each split by a hash of its key into buckets:
``<table>/store_version=<n>/store_bucket=<k>``.  A commit writes only the buckets that its
changes touch, under a new version, and then one ledger entry that says for
every bucket which versions hold it (more than one if rows were added or taken away beside it); all other buckets are carried by reference.
The ledger entry, a single file, is the commit: a reader sees all of a version's
tables or none, and files of a commit that never came are not referred to.

Each entry names the micro-batch it came from.  A batch that is handed over
again after a failure is recognised and changes nothing, which makes
``foreachBatch`` exactly-once.  Old versions stay readable (``version=``).

Scale: a commit reads and writes the touched buckets only, so its cost follows
the change set (with more buckets, the closer); a change that names the keys whose
rows go (``gone``) writes those keys and its new rows beside the stored files, which
readers join with them, and a bucket is rewritten only once it has ``LAYERS`` such parts; a bucket that holds many of the
rows is written by several tasks (``rebalance``; a commit, whose rows come from joins,
writes them from there, a file a task and bucket); files are sorted by key, or by
the layout columns that a table names, so that filters on them skip row groups; the manifest that the driver
reads has one row a table and bucket, whatever the tables hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

ENTRY = "batch long, table string, key string, kind string, buckets int, bucket int, at int, facts string, layout string, under array<int>, gone array<int>"
VERSION, BUCKET, GONE = "store_version", "store_bucket", "store_gone"  # folder names, so no column names of a table
LAYERS = 16  # parts beside a bucket's first files before a change with ``gone`` rewrites it


@dataclass(frozen=True)
class Change:
    """What a batch does to a table: ``rows`` maps the stored rows of the buckets
    that ``keys`` (one column, or the numbers that ``touched`` gave) touch to those
    buckets' new rows.  Rows of ``more`` are added to what their buckets hold: of
    those that ``keys`` does not touch nothing is read or written again.  All stored
    rows of the keys ``gone`` (one column) go, before ``more`` is added; they too are
    left where they are, and what goes is noted beside them."""

    keys: DataFrame | list[int] = field(default_factory=list)
    rows: Callable[[DataFrame], DataFrame] | None = None
    more: DataFrame | None = None
    gone: DataFrame | None = None


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        """Open the store at ``path`` (see ``create``)."""
        self.spark, self.path = spark, path.rstrip("/")
        self._last: tuple[int, list] | None = None  # the last version and its manifest: a store has one writer

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, tuple], buckets: int = 16,
               facts: dict | None = None, gather: bool = True) -> SnapshotStore:
        """A new store of ``tables`` (frame, key column, and if wanted the columns that files are sorted by in place of
        the key): version 0, before any batch.  Without ``gather`` no row is shuffled for it, and a bucket has a file a task."""
        store = cls(spark, path)
        entries = []
        for name, (df, key, *layout) in tables.items():
            if {VERSION, BUCKET, GONE} & {c.lower() for c in df.columns}:
                raise ValueError(f"a column of {name} is named {VERSION}, {BUCKET} or {GONE}")
            kind = df.schema.json()
            order = layout[0] if layout else [key]
            held = store._write(name, 0, df, key, buckets, order, gather)
            entries += [(-1, name, key, kind, buckets, b, 0 if b in held else None, json.dumps(facts or {}), json.dumps(order), [], [])
                        for b in range(buckets)]
        store._enter(0, entries)
        return store

    # ---- reading

    def version(self) -> int:
        """The last committed version."""
        return self._newest()[0]

    def applied(self) -> int:
        """The last batch that was committed, -1 before any."""
        return self._newest()[1][0]["batch"]

    def facts(self) -> dict:
        """What the last commit noted beside the tables."""
        return json.loads(self._newest()[1][0]["facts"])

    def places(self, table: str, version: int | None = None) -> dict[int, int | None]:
        """For each bucket the version that wrote it last; null if it is empty."""
        return {r["bucket"]: r["at"] for r in self._rows_of(table, version)}

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of ``keys`` (one column): at most as many numbers as there are buckets."""
        (name,) = keys.columns
        bucket = self._bucket(self._rows_of(table)[0], F.col(name))
        return sorted(r[0] for r in keys.select(bucket.alias("b")).distinct().collect())

    def read(self, table: str, keys: DataFrame | list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of ``table``; with ``keys`` only the buckets that they touch."""
        wanted = self.touched(table, keys) if isinstance(keys, DataFrame) else keys
        return self._scan(table, self._rows_of(table, version), wanted)

    # ---- writing

    def commit(self, batch: int | None, changes: dict[str, Change], facts: dict | None = None) -> bool:
        """Apply ``changes`` as one version; False, and nothing done, if ``batch`` was committed before.  Without a
        batch (a change that no stream brought) the number of the last one stays."""
        if batch is None:
            batch = self.applied()
        elif batch <= self.applied():
            return False
        now, manifest = self._newest()
        new = now + 1
        places = {(r["table"], r["bucket"]): (r["at"], r["under"] or [], r["gone"] or []) for r in manifest}
        for name, change in changes.items():
            rows = [r for r in manifest if r["table"] == name]
            touched = self.touched(name, change.keys) if isinstance(change.keys, DataFrame) else change.keys
            lost = [] if change.gone is None else [b for b in self.touched(name, change.gone) if places[name, b][0] is not None]
            if change.gone is not None:
                if touched:
                    raise ValueError(f"a change of {name} has both keys and gone")
                touched = [b for b in lost if len(places[name, b][1]) + len(places[name, b][2]) >= LAYERS]
                lost = [b for b in lost if b not in touched]
            if not touched and not lost and change.more is None:
                continue
            schema = StructType.fromJson(json.loads(rows[0]["kind"]))
            fresh = []
            if touched:
                stored = self._scan(name, rows, touched)
                fresh.append(change.rows(stored) if change.gone is None else self._without(stored, rows[0], change.gone))
            if change.more is not None:
                fresh.append(change.more)
            held = set()
            if fresh:
                fresh = reduce(DataFrame.unionByName, [df.select(*schema.names) for df in fresh])
                fresh = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
                held = self._write(name, new, fresh, rows[0]["key"], rows[0]["buckets"], json.loads(rows[0]["layout"]), gather=False)
            beside = held - set(touched)
            if beside and change.more is None:
                raise ValueError(f"a change of {name} gave rows of buckets that its keys do not touch")
            if lost:
                keys = change.gone.select(F.col(change.gone.columns[0]).cast(schema[rows[0]["key"]].dataType).alias(GONE)).distinct()
                keys = keys.where(F.pmod(F.xxhash64(GONE), F.lit(rows[0]["buckets"])).isin(lost))
                self._write(f"{name}/{GONE}", new, keys, GONE, rows[0]["buckets"])
                for b in lost:
                    at, under, gone = places[name, b]
                    places[name, b] = at, under, [*gone, new]
            for b in beside:
                at, under, gone = places[name, b]
                places[name, b] = new, [*under, *([] if at is None else [at])], gone
            places.update({(name, b): (new if b in held else None, [], []) for b in touched})
        noted = manifest[0]["facts"] if facts is None else json.dumps(facts)
        self._enter(new, [(batch, r["table"], r["key"], r["kind"], r["buckets"], r["bucket"], places[r["table"], r["bucket"]][0], noted,
                           r["layout"], *places[r["table"], r["bucket"]][1:]) for r in manifest])
        return True

    # ---- files

    def _newest(self) -> tuple[int, list]:
        if self._last is None:
            ledger = self.spark.read.schema(ENTRY + ", version int").parquet(f"{self.path}/ledger")
            version = ledger.agg(F.max("version")).first()[0]
            if version is None:
                raise ValueError(f"no store in {self.path}")
            self._last = version, self._manifest(version)
        return self._last

    def _manifest(self, version: int) -> list:
        """One row a table and bucket."""
        found = self.spark.read.schema(ENTRY).parquet(f"{self.path}/ledger/version={version}").collect()
        return sorted(found, key=lambda r: (r["table"], r["bucket"]))

    def _rows_of(self, table: str, version: int | None = None) -> list:
        manifest = self._newest()[1] if version is None else self._manifest(version)
        rows = [r for r in manifest if r["table"] == table]
        if not rows:
            raise KeyError(table)
        return rows

    def _enter(self, version: int, entries: list[tuple]) -> None:
        df = self.spark.createDataFrame(entries, ENTRY)
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/version={version}")
        self._last = version, [Row(**dict(zip(df.columns, e))) for e in sorted(entries, key=lambda e: (e[1], e[5]))]

    def _bucket(self, row, key: Column) -> Column:
        kind = StructType.fromJson(json.loads(row["kind"]))[row["key"]].dataType
        return F.pmod(F.xxhash64(key.cast(kind)), F.lit(row["buckets"])).cast("int")

    def _scan(self, table: str, rows: list, wanted: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(rows[0]["kind"]))
        root = f"{self.path}/{table}"
        paths = [f"{root}/{VERSION}={at}/{BUCKET}={r['bucket']}" for r in rows
                 if r["at"] is not None and (wanted is None or r["bucket"] in wanted) for at in (*(r["under"] or ()), r["at"])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self._files(root, paths, schema)
        gone = [f"{root}/{GONE}/{VERSION}={at}/{BUCKET}={r['bucket']}" for r in rows
                if wanted is None or r["bucket"] in wanted for at in r["gone"] or ()]
        if gone:
            key = rows[0]["key"]
            noted = self._files(f"{root}/{GONE}", gone, StructType([StructField(GONE, schema[key].dataType)]))
            noted = noted.select(F.col(GONE), F.col(VERSION).alias("_gone_at"))
            # rows that are as old as what took their key away, or younger, were put in its place
            found = found.join(noted, found[key].eqNullSafe(noted[GONE]) & (found[VERSION] < noted["_gone_at"]), "left_anti")
        return found.select(*[F.col(f.name) for f in schema.fields])

    def _files(self, root: str, paths: list[str], schema: StructType) -> DataFrame:
        """Rows of the folders ``paths`` with their version and bucket."""
        marks = [StructField(VERSION, IntegerType()), StructField(BUCKET, IntegerType())]
        return self.spark.read.schema(StructType([*schema.fields, *marks])).option("basePath", root).parquet(*paths)

    @staticmethod
    def _without(stored: DataFrame, row, gone: DataFrame) -> DataFrame:
        keys = gone.select(F.col(gone.columns[0]).cast(stored.schema[row["key"]].dataType).alias(GONE))
        return stored.join(keys, stored[row["key"]].eqNullSafe(keys[GONE]), "left_anti")

    def _write(self, table: str, version: int, df: DataFrame, key: str, buckets: int, order: list[str] | None = None,
               gather: bool = True) -> set[int]:
        """Write ``df`` as ``version``; the buckets that hold rows.  ``gather`` brings a bucket's rows together first, for fewer
        files; without it each task writes its own files of the buckets that it meets, and no row is shuffled once more."""
        path = f"{self.path}/{table}/{VERSION}={version}"
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        held = Observation()
        marked = df.withColumn(BUCKET, bucket)
        if gather:
            marked = marked.hint("rebalance", BUCKET)
        marked = marked.sortWithinPartitions(BUCKET, *(order or [key])).observe(held, F.collect_set(BUCKET).alias("held"))
        marked.write.mode("overwrite").partitionBy(BUCKET).option("compression", "zstd").parquet(path)
        return set(held.get["held"])
