"""The two-pass shuffle against a plain restatement; uniform order, equal shards, edge rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklens.llm import sharding as S

SCHEMA = "doc_id long, text string, slot string, extra map<string,int>"
EDGE = [
    (1, "a", "s", {"x": 1}), (1, "a", "s", {"x": 1}), (1, "a", "s", {"x": 2}), (None, None, None, None), (None, None, None, None), (2, "", "", {}),
    (3, "ñ中" * 10, None, None), (4, "w " * 40_000, "q", None), (None, "a", "s", None), (5, None, "1", None),
]


def keyed(spark, df, buckets, seed):
    """Every row with its hashes, by Spark's hash function; bucket and order follow from them below."""
    rows = S.numbered(df)
    return rows.select(
        "row", "turn", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "turn"), F.lit(buckets)).alias("bucket"),
        F.xxhash64(F.lit(seed), F.lit("order"), "k1", "k2", "turn").alias("h")).collect()


def plain(rows, shards, seed):
    """(row, shard, slot): buckets one after the other, each sorted by hash and then shuffled, cut into equal parts."""
    order = []
    for b in sorted({r.bucket for r in rows}):
        own = sorted((r for r in rows if r.bucket == b), key=lambda r: r.h)
        order += [own[i] for i in np.random.Generator(np.random.PCG64([seed, b])).permutation(len(own))]
    cuts = [s * len(order) // shards for s in range(shards + 1)]
    return [(r.row, s, i - cuts[s]) for s in range(shards) for i, r in enumerate(order) if cuts[s] <= i < cuts[s + 1]]


@pytest.mark.parametrize("shards,bucket_bytes", [(8, 1 << 30), (3, 60_000), (1, 20_000)])
def test_equals_plain_shuffle(spark, shards, bucket_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    size = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    want = plain(keyed(spark, docs, -(-size // bucket_bytes), S.SEED), shards, S.SEED)
    got = S.shard(docs, shards, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.shard, r.slot, r.doc_id, r.text) for r in got) == sorted((s, i, w.doc_id, w.text) for w, s, i in want)
    again = S.shard(docs.repartition(5), shards, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.shard, r.slot, r.doc_id) for r in got) == sorted((r.shard, r.slot, r.doc_id) for r in again)


def test_shards_are_equal_and_random(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = S.shard(rows, 8, bucket_bytes=30_000).collect()
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(2500)) for v in slots.values())
    # Each shard holds about as many of the first ids as of the last, and neighbours part.
    halves = Counter((r.shard, r.doc_id < 10_000) for r in got)
    assert all(abs(n - 1250) < 6 * 25 for n in halves.values())
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    assert sum(place[i][0] == place[i + 1][0] for i in range(19_999)) < 0.16 * 20_000
    other = S.shard(rows, 8, seed=14, bucket_bytes=30_000).collect()
    assert sum(place[r.doc_id] == (r.shard, r.slot) for r in other) < 30


def test_fisher_yates_orders_are_equally_likely():
    seen = Counter(tuple(S.fisher_yates(3, seed, 0)) for seed in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_equal_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "REPEATS", 100)
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    numbered = S.numbered(rows)
    assert numbered.count() == 4000 and numbered.select("k1", "k2", "turn").distinct().count() == 4000
    buckets = Counter(r.bucket for r in S.shuffled(rows, bucket_bytes=1000).filter("row.doc_id is null").collect())
    assert len(buckets) == 8 and max(buckets.values()) < 500
    assert sorted(Counter(r.shard for r in S.shard(rows, 7).collect()).values()) == [571] * 4 + [572] * 3


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_edge_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr("decklens.llm.common.BROADCAST_BYTES", broadcast)
    df = spark.createDataFrame(EDGE, SCHEMA)
    got = S.shard(df, 4).collect()
    key = lambda i, t, e: repr((i, t, e))
    assert sorted(key(r.doc_id, r.text, r.extra) for r in got) == sorted(key(i, t, e) for i, t, _, e in EDGE)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got) and df.columns[:2] == list(got[0].asDict())[:2]
    assert sorted(Counter(r.shard for r in got).values()) == [2, 2, 3, 3]
    assert S.shard(df.limit(0)).collect() == []
    few = S.shard(df.filter("doc_id = 1"), 8).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few) and len({r.shard for r in few}) == 3


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = S.shard(docs, 4, bucket_bytes=50_000)
    S.write_shards(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.doc_id for r in back.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
