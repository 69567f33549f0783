"""Known file hashes as a stored index: a Bloom filter per bucket in front of the exact test.

Hashes lie in buckets. Each bucket has a bitmap, which rules out nearly every new hash, and its exact hashes as
a stored table; only the buckets of the hashes that the bitmaps let through are read, and only
those hashes are compared. So a batch of new files reads little of the known ones, and a false
positive is settled exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens.session import staged
from decklens.sources.keyed_table import KeyedTable

#: bits set for each hash, and bits of a bitmap for each hash that its bucket holds on average
PROBES, BITS_PER_HASH = 7, 12


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Bits of each hash: hashes by PROBES."""
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * (second[:, None] | np.uint64(1))) % np.uint64(size)


def _lanes() -> list[Column]:
    return [F.xxhash64(F.lit(lane), "hash").alias(f"h{lane}") for lane in (1, 2)]


class HashIndex:
    """The index below ``folder``, in a store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hashes = KeyedTable(spark, f"{self.folder}/hashes")
        self.bitmaps = KeyedTable(spark, f"{self.folder}/bitmaps")

    def create(self, versions: DataFrame, buckets: int = 64) -> HashIndex:
        """Index the hashes of ``versions``; null hashes are known to nobody and are left out."""
        known = staged(versions.select("hash").filter(F.col("hash").isNotNull()).distinct())
        self.hashes.create(known, ["hash"], buckets)
        size = 8 * max(8, -(-known.count() * BITS_PER_HASH // (8 * buckets)))
        self.bitmaps.create(self._built(known, buckets, size), ["bucket"], buckets)
        return self

    def add(self, change_id: str, versions: DataFrame) -> bool:
        """Take in further hashes; False if ``change_id`` was taken in before. Only their buckets are rewritten.

        Bitmaps are changed first: a hash that only they know is settled as unknown, not missed.
        """
        m = self.hashes.manifest()
        fresh = staged(versions.select("hash").filter(F.col("hash").isNotNull()).distinct())
        size = (self.bitmaps.read().select(F.max(F.octet_length("bits"))).first()[0] or 8) * 8
        more = staged(self._built(fresh, m.buckets, size))

        def merged(old: DataFrame) -> DataFrame:
            return self._joined(old.unionByName(more))

        self.bitmaps.change(change_id, more, merged)
        return self.hashes.upsert(change_id, fresh, ["hash"])

    def _placed(self, hashes: DataFrame, buckets: int) -> DataFrame:
        return hashes.select("hash", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int").alias("bucket"), *_lanes())

    def _built(self, hashes: DataFrame, buckets: int, size: int) -> DataFrame:
        """(bucket, bits): one bitmap per bucket that has hashes, filled as its hashes pass by."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                bucket, first, second = (b.column(c).to_numpy() for c in ("bucket", "h1", "h2"))
                places = _places(first.view(np.uint64), second.view(np.uint64), size)
                for k in np.unique(bucket).tolist():
                    held.setdefault(k, np.zeros(size, bool))[places[bucket == k].ravel()] = True
            for k, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["bucket", "bits"])

        # A task has few buckets, and only those.
        parts = self._placed(hashes, buckets).repartition("bucket").select("bucket", "h1", "h2")
        return self._joined(parts.mapInArrow(of, "bucket int, bits binary"))

    @staticmethod
    def _joined(rows: DataFrame) -> DataFrame:
        """Bitmaps of the same bucket laid over one another."""

        def of(batch: pa.Table) -> pa.Table:
            bits = [np.frombuffer(x, np.uint8) for x in batch.column("bits").to_pylist()]
            return pa.table({"bucket": batch.column("bucket").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(bits).tobytes()], pa.binary())})

        return rows.groupBy("bucket").applyInArrow(of, "bucket int, bits binary")

    def maybe(self, hashes: DataFrame) -> DataFrame:
        """Of distinct ``hashes``, those that the bitmaps do not rule out: ``(hash, bucket)``."""
        buckets = self.hashes.manifest().buckets
        none = F.lit(None)
        asked = self._placed(hashes, buckets).withColumn("bits", none.cast("binary"))
        maps = self.bitmaps.read().select(none.cast("string").alias("hash"), "bucket", none.cast("long").alias("h1"), none.cast("long").alias("h2"), "bits")
        # A bucket's bitmap sorts before its hashes (nulls first), so each task holds one bitmap at a time.
        rows = maps.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "hash")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, bits = None, None
            for b in batches:
                of_bucket = b.column("bucket").to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(of_bucket)) + 1).tolist(), len(of_bucket)]
                for i, j in zip(starts, starts[1:]):
                    if i == j:
                        continue
                    part = b.slice(i, j - i)
                    if bucket != of_bucket[i]:
                        bucket, bits = int(of_bucket[i]), None
                    if part.column("hash")[0].as_py() is None:
                        bits = np.unpackbits(np.frombuffer(part.column("bits")[0].as_py(), np.uint8)).astype(bool)
                        part = part.slice(1)
                    if bits is None or not part.num_rows:
                        continue
                    first, second = (part.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                    hit = bits[_places(first, second, len(bits))].all(1)
                    yield part.select(["hash", "bucket"]).filter(pa.array(hit))

        return rows.mapInArrow(of, "hash string, bucket int")

    def known(self, hashes: DataFrame) -> DataFrame:
        """Of distinct ``hashes``, those that are known."""
        maybe = staged(self.maybe(hashes.select("hash")))
        exact = self.hashes.read_keys(maybe.select("hash"))
        return maybe.select("hash").join(exact, "hash", "left_semi")
