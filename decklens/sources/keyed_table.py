"""A stored table that is changed by key: hash buckets, and a manifest that is swapped last.

Rows lie in buckets by the hash of ``bucket_by``. A change reads the buckets of its keys only, writes
their new contents into a folder of its own, and then publishes a manifest that names, for each
bucket, the folder it is in now. Manifests are numbered files that are created whole and never changed; the highest
number counts. So a reader sees the table before or after a change, a failed change leaves the table as
it was, of two writers that started from the same manifest one fails, and a change whose id the
manifest has already is not applied again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens.session import staged

_BUCKET = "_bucket"


class ConcurrentChange(RuntimeError):
    """Another writer has published since this change began."""


@dataclass(frozen=True)
class Manifest:
    number: int
    buckets: int
    bucket_by: list[str]
    schema: str
    folders: dict[int, str]
    applied: list[str]


class KeyedTable:
    """The table below ``folder``, in a store that Spark reads."""

    #: ids of changes that a manifest remembers
    REMEMBERED = 10_000

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- manifests -----------------------------------------------------------------------------------

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, store = self._store()
        if not store.exists(path):
            return []
        names = [f.getPath().getName() for f in store.listStatus(path)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self, number: int | None = None) -> Manifest:
        number = self._numbers()[-1] if number is None else number
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{number}.json").first()[0]
        read = json.loads(text)
        return Manifest(**{**read, "folders": {int(b): f for b, f in read["folders"].items()}})

    def _publish(self, m: Manifest) -> None:
        path, store = self._store()
        jvm = self.spark.sparkContext._jvm
        store.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(path, f".draft-{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(json.dumps(m.__dict__).encode())
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(path, f"{m.number}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, never)  # fails if the file is there
        except Exception as e:
            store.delete(draft, False)
            if store.exists(final):
                raise ConcurrentChange(f"manifest {m.number} exists already") from e
            raise

    # --- rows ------------------------------------------------------------------------------------------

    def _placed(self, rows: DataFrame, bucket_by: list[str], buckets: int) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in bucket_by]), F.lit(buckets)).cast("int"))

    def create(self, rows: DataFrame, bucket_by: list[str], buckets: int = 256) -> KeyedTable:
        """Store ``rows`` as the first state of the table."""
        folder = f"data/{uuid.uuid4().hex}"
        self._placed(rows, bucket_by, buckets).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{folder}")
        folders = {b: folder for b in range(buckets)}
        self._publish(Manifest(0, buckets, bucket_by, rows.schema.json(), folders, []))
        return self

    def _read(self, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        of_folder: dict[str, list[int]] = {}
        for b, folder in m.folders.items():
            if buckets is None or b in buckets:
                of_folder.setdefault(folder, []).append(b)
        out = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())]))
        for folder, own in of_folder.items():
            rows = self.spark.read.schema(out.schema).parquet(f"{self.folder}/{folder}")
            out = out.unionByName(rows.filter(F.col(_BUCKET).isin(own)))
        return out.drop(_BUCKET)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of its newest manifest, or of an older one that has not been cleared."""
        return self._read(self.manifest(number))

    def _touched(self, m: Manifest, keys: DataFrame) -> set[int]:
        """Buckets of the keys: at most as many as there are buckets."""
        placed = self._placed(keys.select(*m.bucket_by), m.bucket_by, m.buckets)
        return {r[0] for r in placed.select(_BUCKET).distinct().collect()}

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """All rows of the buckets that ``keys`` (the bucket columns) fall into."""
        m = self.manifest()
        return self._read(m, self._touched(m, keys))

    def change(self, change_id: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Replace the rows of the buckets of ``touched`` (the bucket columns) by ``change`` of them.

        ``change`` gets every row of those buckets and returns every row they hold afterwards, new
        ones of touched keys included. False if ``change_id`` has been applied before.
        """
        m = self.manifest()
        if change_id in m.applied:
            return False
        buckets = self._touched(m, touched)
        folders = dict(m.folders)
        if buckets:
            folder = f"data/{uuid.uuid4().hex}"
            old = self._read(m, buckets)
            new = self._placed(change(old).select(*old.columns), m.bucket_by, m.buckets)
            wrong = F.when(~F.col(_BUCKET).isin(*buckets), F.raise_error(F.lit("a change brings rows of keys it does not touch")))
            new = new.withColumn(_BUCKET, F.coalesce(wrong.cast("int"), F.col(_BUCKET)))
            new.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{folder}")
            folders |= {b: folder for b in buckets}
        self._publish(Manifest(m.number + 1, m.buckets, m.bucket_by, m.schema, folders, [*m.applied, change_id][-self.REMEMBERED :]))
        return True

    def upsert(self, change_id: str, changes: DataFrame, keys: list[str]) -> bool:
        """Replace or add the rows of ``changes`` by ``keys`` (which hold the bucket columns); of several
        changes of one key, the one with the greatest values, column by column, counts."""
        rest = [c for c in changes.columns if c not in keys]
        new = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_new")).select(*keys, "_new.*") if rest else changes.distinct()
        new = staged(new)
        return self.change(change_id, new, lambda old: old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns)))

    def delete(self, change_id: str, gone: DataFrame, keys: list[str]) -> bool:
        """Remove the rows whose ``keys`` (which hold the bucket columns) are in ``gone``."""
        gone = staged(gone.select(*keys))
        return self.change(change_id, gone, lambda old: old.join(gone, keys, "left_anti"))

    def clear(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and the folders that none of those names."""
        numbers = self._numbers()
        path, store = self._store()
        jvm = self.spark.sparkContext._jvm
        named = {f for n in numbers[-keep:] for f in self.manifest(n).folders.values()}
        for n in numbers[:-keep]:
            store.delete(jvm.org.apache.hadoop.fs.Path(path, f"{n}.json"), False)
        data = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        for f in store.listStatus(data):
            if f"data/{f.getPath().getName()}" not in named:
                store.delete(f.getPath(), True)
