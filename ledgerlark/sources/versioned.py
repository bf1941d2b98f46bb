"""Tables whose rows change in place: a log of changes, compacted snapshots by bucket, and a manifest that swaps both.

A change has a key, a sequence number and the columns that it sets; it may set a column to null, and what it doesn't set
keeps its value. Of changes to one column of a key the highest sequence number holds, whatever the order in which batches
arrive, and a batch that is appended again replaces itself. A tombstone is a change that sets ``deleted_at``: readers
leave the row out, it isn't removed.

Layout under a table's folder: ``changes/batch=<id>`` has the changes, ``buckets/v=<n>`` the compacted rows by bucket of
the key's hash, ``manifest/v=<n>`` the number of buckets, the folder that holds each bucket, and the batches that are in
them. A manifest is complete or not there; readers take the newest, and the changes of batches that it doesn't name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
_DELETED = "deleted_at"


class VersionedTable:
    """``key``, ``columns``: name to type of the key's columns and of all others; ``deleted_at timestamp`` is added.

    ``buckets``, a power of two, holds for a new table; one that is there keeps its own number.
    """

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str], columns: dict[str, str], buckets: int = BUCKETS):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.columns = columns | {_DELETED: "timestamp"}

    # ---- writing ----

    def append(self, changes: DataFrame, batch_id: str, sets: Iterable[str]) -> None:
        """Writes a batch of ``changes(<key>, seq, <sets>)`` that set the columns ``sets``; null counts as a value.

        A change with a null in its key or its sequence number changes nothing. Of rows with equal key and number the
        greatest value of each column holds, so that every order of rows gives one state.
        """
        sets = list(sets)
        if unknown := set(sets) - set(self.columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        cells = [F.struct(F.col("seq").cast("long").alias("seq"), F.col(c).cast(t).alias("value")).alias(c) if c in sets else F.lit(None).cast(self._cell(t)).alias(c) for c, t in self.columns.items()]
        whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in (*self.key, "seq")])
        rows = changes.where(whole).select(*[F.col(k).cast(t).alias(k) for k, t in self.key.items()], *cells)
        merged = self._merge(rows).withColumn("_bucket", self._bucket())
        merged.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def delete(self, keys: DataFrame, batch_id: str) -> None:
        """Marks rows as deleted: ``keys(<key>, seq, deleted_at)``; a null deleted_at brings a row back."""
        self.append(keys, batch_id, [_DELETED])

    def compact(self) -> int | None:
        """Folds all changes into new snapshots of the buckets that they touch; the new version, or None without changes.

        Buckets without changes keep their files. If it ends half way the old manifest holds, and nothing is lost.
        """
        now, done, places, n = self._manifest()
        todo = [b for b in self._batches() if b not in done]
        if not todo:
            return None
        changes = self._changes(todo)
        touched = sorted(r[0] for r in changes.select(F.pmod("_bucket", F.lit(n)).alias("b")).distinct().collect())  # at most a number a bucket
        version = now + 1
        kept = {b: v for b, v in places.items() if b in touched}
        rows = changes.drop("_bucket")
        rows = rows.unionByName(self._stored(kept)) if kept else rows
        merged = self._merge(rows).withColumn("_bucket", self._bucket(n))
        target = f"{self.path}/buckets/v={version}"
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
        places |= {b: version for b in touched}
        self._publish(version, n, places, [*done, *todo])
        return version

    def purge(self, where: Callable[[dict[str, Column]], Column]) -> int | None:
        """Removes rows for good, rewriting only the buckets that hold such rows; the new version, or None without any.

        ``where`` gets the columns by name. Changes are compacted first, as they could bring a row back.
        """
        self.compact()
        now, done, places, n = self._manifest()
        if not places:
            return None
        gone = where({k: F.col(k) for k in self.key} | {c: F.col(c)["value"] for c in self.columns})
        rows = self._stored(places).withColumn("_bucket", self._bucket(n)).withColumn("_gone", F.coalesce(gone, F.lit(False)))
        hit = sorted(r[0] for r in rows.where("_gone").select("_bucket").distinct().collect())  # at most a number a bucket
        if not hit:
            return None
        version = now + 1
        rest = self._stored({b: places[b] for b in hit}).withColumn("_bucket", self._bucket(n)).where(~F.coalesce(gone, F.lit(False)))
        rest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/buckets/v={version}")
        left = {int(b) for b in self._names(f"{self.path}/buckets/v={version}", "_bucket=")}
        self._publish(version, n, {b: version if b in hit else v for b, v in places.items() if b not in hit or b in left}, done)
        return version

    def vacuum(self) -> list[str]:
        """Removes changes that are compacted and folders of buckets that the newest manifest doesn't name; their paths."""
        _, done, places, _ = self._manifest()
        old = [f"{self.path}/changes/batch={b}" for b in self._batches() if b in done]
        for folder in self._names(f"{self.path}/buckets", "v="):
            used = {b for b, v in places.items() if str(v) == folder}
            if not used:
                old.append(f"{self.path}/buckets/v={folder}")
            else:
                old += [f"{self.path}/buckets/v={folder}/_bucket={b}" for b in self._names(f"{self.path}/buckets/v={folder}", "_bucket=") if int(b) not in used]
        for p in old:
            path = self._path(p)
            path.getFileSystem(self._conf()).delete(path, True)
        return old

    # ---- reading ----

    def read(self, deleted: bool = False, history: bool = False) -> DataFrame:
        """The rows as they are now: key and columns; ``deleted`` rows too if asked. ``history`` adds the number of each column's last change."""
        _, done, places, _ = self._manifest()
        todo = [b for b in self._batches() if b not in done]
        parts = ([self._stored(places)] if places else []) + ([self._changes(todo).drop("_bucket")] if todo else [])
        names = [*self.key, *self.columns]
        if not parts:
            empty = ", ".join(f"{c} {t}" for c, t in (self.key | self.columns).items())
            rows = self.spark.createDataFrame([], empty)
            rows = rows.withColumns({f"{c}_seq": F.lit(None).cast("long") for c in self.columns}) if history else rows
            return rows if deleted else rows.drop(_DELETED)
        merged = parts[0] if not todo else self._merge(reduce(DataFrame.unionByName, parts))
        shown = merged.select(*self.key, *[F.col(c)["value"].alias(c) for c in self.columns], *([F.col(c)["seq"].alias(f"{c}_seq") for c in self.columns] if history else []))
        return shown.select(*names, *[c for c in shown.columns if c not in names]) if deleted else shown.where(F.col(_DELETED).isNull()).drop(_DELETED)

    def files(self) -> dict[int, list[str]]:
        """The names of each bucket's files in the newest version."""
        places = self._manifest()[2]
        return {b: sorted(x for x in self._names(f"{self.path}/buckets/v={v}/_bucket={b}", "") if x.endswith(".parquet")) for b, v in places.items()}

    # ---- inside ----

    @staticmethod
    def _cell(kind: str) -> str:
        return f"struct<seq:bigint,value:{kind}>"

    def _bucket(self, n: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n or 1 << 20)).cast("int")

    def _merge(self, rows: DataFrame) -> DataFrame:
        """One row a key: of each column the cell of the highest number, with map-side combine."""
        return rows.groupBy(*self.key).agg(*[F.max(c).alias(c) for c in self.columns])

    def _changes(self, batches: list[str]) -> DataFrame:
        schema = ", ".join([*(f"{k} {t}" for k, t in self.key.items()), *(f"{c} {self._cell(t)}" for c, t in self.columns.items()), "_bucket int"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/changes/batch={b}" for b in batches])

    def _stored(self, places: dict[int, int]) -> DataFrame:
        schema = ", ".join([*(f"{k} {t}" for k, t in self.key.items()), *(f"{c} {self._cell(t)}" for c, t in self.columns.items())])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/buckets/v={v}/_bucket={b}" for b, v in places.items()])

    def _publish(self, version: int, n: int, places: dict[int, int], batches: list[str]) -> None:
        row = [(n, [(int(b), int(v)) for b, v in sorted(places.items())], list(batches))]
        self.spark.createDataFrame(row, "buckets int, places array<struct<bucket:int,version:int>>, batches array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def _manifest(self) -> tuple[int, list[str], dict[int, int], int]:
        """(version, batches, bucket to version of its folder, number of buckets) of the newest complete manifest."""
        for v in sorted((int(x) for x in self._names(f"{self.path}/manifest", "v=")), reverse=True):
            if "_SUCCESS" in self._names(f"{self.path}/manifest/v={v}", ""):
                row = self.spark.read.parquet(f"{self.path}/manifest/v={v}").first()
                return v, list(row["batches"]), {p["bucket"]: p["version"] for p in row["places"]}, row["buckets"]
        return 0, [], {}, self.buckets

    def _batches(self) -> list[str]:
        return [b for b in self._names(f"{self.path}/changes", "batch=") if "_SUCCESS" in self._names(f"{self.path}/changes/batch={b}", "")]

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _names(self, folder: str, prefix: str) -> list[str]:
        """The names in a folder that begin with ``prefix``, without it."""
        path = self._path(folder)
        fs = path.getFileSystem(self._conf())
        if not fs.exists(path):
            return []
        return sorted(n[len(prefix) :] for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith(prefix))
