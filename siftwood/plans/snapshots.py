"""Snapshots in hash buckets, of which a batch rewrites only those that it touches, and a ledger of the batches that are in them.

A store holds several tables. A table's rows lie in buckets by the hash of its key, each bucket in the version directory that wrote it last. What the
tables hold is said by one small file, the state: for every table the version of each bucket, and for every stream the last batch that is in. A
batch first writes its buckets to a directory of its own, which nobody reads yet, and then the next state, whose creation
under its number either happens or does not. So all tables change at once, a batch that was cut short leaves nothing that counts,
and a batch that comes again after its state was written is known and left out.

The state grows with buckets, not with rows; it and the list of touched buckets are all that the driver holds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


@dataclass(frozen=True)
class Table:
    key: str
    schema: StructType
    buckets: int = 256


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/state"))

    # ------------------------------------------------------------ state

    def _states(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/state")))
        return sorted(int(n) for n in names if n.isdigit())

    def state(self) -> dict:
        """The present state: version, batches (last batch of each stream), tables (version of each bucket)."""
        states = self._states()
        if not states:
            return {"version": 0, "batches": {}, "tables": {name: {} for name in self.tables}}
        stream = self._fs.open(self._path(f"{self.root}/state/{states[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """Writes the state beside its place and moves it there; if another has taken the place meanwhile, nothing has changed."""
        done = self._path(f"{self.root}/state/{state['version']}")
        draft = self._path(f"{self.root}/state/draft-{state['version']}")
        out = self._fs.create(draft, True)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        if self._fs.exists(done) or not self._fs.rename(draft, done):
            raise RuntimeError(f"version {state['version']} was written by another batch")

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream, or a later one, is in the tables."""
        return self.state()["batches"].get(stream, -1) >= batch

    # ------------------------------------------------------------ reading

    def bucket_of(self, table: str, key: Column | str | None = None) -> Column:
        t = self.tables[table]
        return F.pmod(F.xxhash64(t.key if key is None else key), F.lit(t.buckets)).cast("int")

    def files(self, table: str) -> dict[int, str]:
        """The directory of each bucket that has rows."""
        return {int(b): f"{self.root}/{table}/version={v}/{BUCKET}={b}" for b, v in self.state()["tables"][table].items()}

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some: no other file is opened."""
        paths = [p for b, p in sorted(self.files(table).items()) if buckets is None or b in buckets]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, table: str, keys: DataFrame) -> set[int]:
        """Buckets in which keys (of one column) lie: at most as many as the table has."""
        return {r[0] for r in keys.select(self.bucket_of(table, keys.columns[0])).distinct().collect()}

    def matching(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a table that have one of the keys, from their buckets alone."""
        key = self.tables[table].key
        wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        return self.read(table, self.touched(table, wanted)).join(wanted, key, "left_semi")

    # ------------------------------------------------------------ writing

    def commit(self, stream: str, batch: int, changes: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, set[int]]:
        """Applies (gone, new) of each table: rows with a key of gone go, rows of new come, all tables at once; the buckets rewritten.

        gone has one column of keys. Rows of new replace rows of their key only if gone holds it. A batch that is in already changes nothing.
        """
        state = self.state()
        if state["batches"].get(stream, -1) >= batch:
            return {}
        version, done = state["version"] + 1, {}
        state["version"] = version
        for name, (gone, new) in changes.items():
            t = self.tables[name]
            out = gone.select(F.col(gone.columns[0]).alias(t.key)).distinct()
            rows = new.select(*(F.col(f.name).cast(f.dataType) for f in t.schema.fields))
            hit = self.touched(name, out.unionByName(rows.select(t.key)))
            whole = self.read(name, hit).join(out, t.key, "left_anti").unionByName(rows).withColumn(BUCKET, self.bucket_of(name))
            path = f"{self.root}/{name}/version={version}"
            # a large bucket is split over tasks and small ones share one, as their sizes turn out
            whole.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
            base = self._path(path)
            filled = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(base) if "=" in f.getPath().getName()}
            kept = {b: v for b, v in state["tables"].setdefault(name, {}).items() if int(b) not in hit}
            state["tables"][name] = kept | {str(b): version for b in filled}
            done[name] = hit
        state["batches"][stream] = batch
        self._publish(state)
        return done

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes what no one of the last states names: older states, and version directories without a bucket in use. For times without a writer; the paths deleted."""
        states = self._states()
        used: set[str] = set()
        for n in states[-keep:]:
            stream = self._fs.open(self._path(f"{self.root}/state/{n}"))
            try:
                told = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            used |= {f"{name}/version={v}" for name, where in told["tables"].items() for v in where.values()}
        gone = [f"state/{n}" for n in states[:-keep]]
        for name in self.tables:
            at = self._path(f"{self.root}/{name}")
            if self._fs.exists(at):
                gone += [p for f in self._fs.listStatus(at) if (p := f"{name}/{f.getPath().getName()}") not in used]
        for p in gone:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)
        return gone
