"""Shards in random order by a two-pass external shuffle.

Pass one scatters the rows over buckets by a seeded hash; there are as many buckets as keep one in a
task's memory. Pass two puts each bucket into an order of its own with a seeded Fisher-Yates shuffle
and writes it. Buckets one after the other are a random order of the table, which is cut into shards
of equal row counts (at most one apart).

The order depends on the seed, the rows and the number of buckets, not on the table's files. Rows that are equal in all
columns are numbered and scattered by that number too, so that any number of them spreads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens.llm.common import measured, staged

SHARDS = 8
SEED = 13
#: Bytes of text in a bucket, on average; a task holds two copies of one bucket.
BUCKET_BYTES = 64 << 20
#: Equal rows that one task brings forth at once.
REPEATS = 1 << 16
#: Bytes of a result batch, about.
OUT_BYTES = 4 << 20


def _plain(kind: T.DataType) -> bool:
    """True if Spark can hash the type: one that holds no map."""
    return "map<" not in kind.simpleString() and not isinstance(kind, (T.VariantType, T.NullType))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, k1, k2, turn): every row with a 128-bit key of its columns; equal rows count from 0."""
    values = [F.col(f"`{f.name}`") if _plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) for f in docs.schema.fields]
    # Nulls do not enter Spark's hash: their places are told apart by a text of flags.
    flags = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    keys = [F.xxhash64(F.lit(lane), flags, *values).alias(f"k{lane}") for lane in (1, 2)]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    repeated = measured(keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), 24)
    once = keyed.join(repeated, ["k1", "k2"], "left_anti").select("row", "k1", "k2", F.lit(0).cast("long").alias("turn"))
    # One of the equal rows stands for all, which are brought forth in parts.
    many = keyed.join(repeated, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row"), F.first("n").alias("n"))
    parts = many.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {REPEATS})"))).repartition("k1", "part")
    turns = F.expr(f"sequence(part * {REPEATS}, least(n, (part + 1) * {REPEATS}) - 1)")
    return once.unionByName(parts.select("row", "k1", "k2", F.explode(turns).alias("turn")))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order of a bucket's n rows: numpy's permutation swaps each place with a random one before it."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(bucket, place, row), staged: the rows of each bucket in random order, places counted from 0."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    buckets = max(1, -(-int(size) // bucket_bytes))
    rows = numbered(docs).select(
        F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "turn"), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(seed), F.lit("order"), "k1", "k2", "turn").alias("h"), "k1", "k2", "turn", "row")
    # Buckets are dealt to partitions in turn; the hash order makes the shuffle repeatable wherever the rows came from.
    tasks = min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scattered = rows.repartitionById(tasks, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "h", "k1", "k2", "turn").select("bucket", "row")

    def emptied(bucket: int, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_arrays(held)
        held.clear()
        order = fisher_yates(len(whole), seed, bucket)
        step = max(1, int(len(whole) * OUT_BYTES / max(whole.nbytes, 1)))
        for i in range(0, len(whole), step):
            took = whole.take(pa.array(order[i : i + step]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(took), bucket, np.int64)), pa.array(np.arange(i, i + len(took))), took], ["bucket", "place", "row"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            of_row = b.column("bucket").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(of_row)) + 1).tolist(), len(of_row)]
            for i, j in zip(starts, starts[1:]):
                if i == j:
                    continue
                if held and of_row[i] != now:
                    yield from emptied(now, held)
                now = int(of_row[i])
                held.append(b.column("row").slice(i, j - i))
        if held:
            yield from emptied(now, held)

    kind = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType()), T.StructField("row", rows.schema["row"].dataType)])
    return staged(scattered.mapInArrow(of, kind))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with size (UTF-8 bytes of the text plus 1), law ('rows'), shard, slot and grown_shard (null).

    Shard s holds the rows from place s n / shards of the order up to the next shard's, so counts differ by one
    at most, and slots count from 0 in each. A null text has size 1; null ids, repeated rows and texts
    of any length are shuffled like others; a bucket grows by what a single row is larger than it. With
    fewer rows than shards some shards stay empty; an empty table gives an empty result. Input columns
    with the names of results are replaced.

    Where buckets begin is summed up in one task, over one row for 64 MB of text.
    """
    rows = shuffled(docs, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = measured(counts.select("bucket", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all")), 24)
    met = rows.join(starts, "bucket").withColumn("at", F.col("start") + F.col("place"))
    met = met.withColumn("shard", F.expr(f"(((at + 1) * {shards} - 1) div all)"))
    found = {
        "size": (F.coalesce(F.octet_length(F.col("row")["text"]), F.lit(0)) + 1).cast("long"), "law": F.lit("rows"), "shard": F.col("shard").cast("int"),
        "slot": F.expr(f"at - (shard * all) div {shards}"), "grown_shard": F.lit(None).cast("int"),
    }
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in found], *[v.alias(c) for c, v in found.items()])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=s`` per shard in Parquet, its rows with their slots; buckets go to their shards without a shuffle."""
    sharded.write.partitionBy("shard").parquet(path)
