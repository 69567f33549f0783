"""Stored tables changed by key, the hash index in front of the exact test, and files of versions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from decklens.operators import catalog as C
from decklens.operators.hash_index import HashIndex
from decklens.sources import analysis as AN
from decklens.sources import version_files as VF
from decklens.sources.keyed_table import ConcurrentChange, KeyedTable


def table(spark, folder, n=1000, buckets=50):
    rows = spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"))
    return KeyedTable(spark, str(folder)).create(rows, ["k"], buckets)


def values(df):
    return {r.k: r.v for r in df.collect()}


def files(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_a_small_change_touches_few_files(spark, tmp_path):
    t = table(spark, tmp_path)
    before = files(tmp_path)
    new = spark.createDataFrame([(str(i), "new") for i in (*range(0, 1000, 200), 5000)] + [("0", "a")], "k string, v string")
    assert t.upsert("one", new, ["k"])
    want = {str(i): "new" if i % 200 == 0 else "old" for i in range(1000)} | {"5000": "new"}
    assert values(t.read()) == want and t.read().count() == 1001
    written = files(tmp_path) - before
    assert 0 < len(written) <= 6 and len(before) >= 45  # buckets of six keys out of 50
    # What the change read: the buckets of its keys.
    touched = t._touched(t.manifest(0), new)
    assert len(touched) <= 6 and t._read(t.manifest(0), touched).count() < 200
    assert not t.upsert("one", new.withColumn("v", F.lit("again")), ["k"])  # the same batch id
    assert values(t.read()) == want and files(tmp_path) - before == written


def test_a_reader_sees_before_or_after(spark, tmp_path):
    t = table(spark, tmp_path, 100, 8)
    earlier = t.read()
    seen = []

    def change(old):
        seen.append(values(t.read()))  # while the change is under way
        return old.withColumn("v", F.lit("new"))

    every = t.read().select("k")
    t.change("all", every, change)
    assert set(seen[0].values()) == {"old"} and set(values(t.read()).values()) == {"new"}
    assert set(values(earlier).values()) == {"old"} and set(values(t.read(0)).values()) == {"old"}
    with pytest.raises(Exception, match="stop"):
        t.change("bad", every, lambda old: old.withColumn("v", F.raise_error(F.lit("stop")).cast("string")))
    assert t.manifest().number == 1 and set(values(t.read()).values()) == {"new"}
    t.delete("some", spark.createDataFrame([("1",), ("2",), ("none",)], "k string"), ["k"])
    assert len(values(t.read())) == 98
    t.clear(keep=1)
    assert len(values(t.read())) == 98 and t._numbers() == [2]


def test_two_writers(spark, tmp_path):
    t = table(spark, tmp_path, 10, 2)
    other = KeyedTable(spark, str(tmp_path))

    def change(old):
        other.delete("first", spark.createDataFrame([("1",)], "k string"), ["k"])
        return old

    with pytest.raises(ConcurrentChange):
        t.change("second", t.read().select("k"), change)
    assert "1" not in values(t.read()) and t.manifest().applied == ["first"]


def test_change_keeps_to_its_keys(spark, tmp_path):
    t = table(spark, tmp_path, 100, 50)
    key = spark.createDataFrame([("1",)], "k string")
    foreign = t.read().filter("k <> '1'")
    with pytest.raises(Exception, match="does not touch"):
        t.change("x", key, lambda old: old.unionByName(foreign))


def test_null_keys_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "k string, v string")
    t = KeyedTable(spark, str(tmp_path)).create(none, ["k"], 4)
    assert t.read().count() == 0 and t.upsert("none", none, ["k"])
    t.upsert("null", spark.createDataFrame([(None, "a"), ("x", None)], "k string, v string"), ["k"])
    assert values(t.read()) == {None: "a", "x": None}


@pytest.mark.parametrize("buckets", [1, 8])
def test_hash_index(spark, tmp_path, monkeypatch, buckets):
    versions = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash")).unionByName(spark.createDataFrame([(None,)], "hash string"))
    index = HashIndex(spark, str(tmp_path)).create(versions, buckets)
    asked = spark.range(2000, 22_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    maybe = index.maybe(asked)
    assert 1000 <= maybe.count() < 1000 + 0.02 * 19_000  # nearly all new ones are ruled out, none of the known
    known = {r.hash for r in index.known(asked).collect()}
    assert known == {r.hash for r in asked.join(versions, "hash", "left_semi").collect()} and len(known) == 1000
    more = spark.range(4000, 4100).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    assert index.add("more", more) and not index.add("more", more)
    assert index.known(asked).count() == 1100 and index.known(asked.limit(0)).count() == 0
    # With bitmaps that rule out nothing, every hash is settled by the exact table.
    full = index.bitmaps.read().select("bucket", F.unhex(F.repeat(F.lit("ff"), 64)).alias("bits"))
    index.bitmaps.change("full", full, lambda old: full)
    assert index.maybe(asked).count() > 19_000 and index.known(asked).count() == 1100


def test_empty_index(spark, tmp_path):
    index = HashIndex(spark, str(tmp_path)).create(spark.createDataFrame([], "hash string"), 4)
    asked = spark.createDataFrame([("a",)], "hash string")
    assert index.known(asked).count() == 0
    index.add("a", asked)
    assert index.known(asked).count() == 1


FILES = "file_id bigint, arrival bigint, length bigint, hash string, total_slides int, subject_id string, file_name string"


@pytest.mark.parametrize("indexed", [False, True])
def test_files_without_a_hash_are_no_copies(spark, tmp_path, indexed):
    rows = [(1, 1, 10, None, 3, "s", "x.pptx"), (2, 2, 10, None, 3, "s", "x.pptx"), (3, 3, 10, None, 0, "s", "z.pptx"), (4, 4, None, "k", 3, "s", "k.pptx"),
            (5, 5, 10, "n", None, "s", "n.pptx"), (6, 6, 10, "m", 2, "s", "m.pptx"), (7, 7, 10, "m", 2, "s", "m2.pptx"), (8, 5, 10, "m", 2, None, "m3.pptx")]
    versions = spark.createDataFrame([("k",), (None,)], "hash string")
    index = HashIndex(spark, str(tmp_path)).create(versions, 2) if indexed else None
    subjects = spark.createDataFrame([("s", "S")], "subject_id string, name string")
    decks, new, rejected = C.register_decks(
        spark.createDataFrame(rows, FILES), subjects, None if indexed else versions, F.lit(dt.date(2024, 1, 1)), index=index)
    assert {r.file_id: r.reason for r in rejected.collect()} == {3: "no_slides", 4: "duplicate", 5: "no_slides", 7: "duplicate", 8: "no_subject"}
    assert sorted(r.file_name for r in decks.collect()) == ["m.pptx", "x.pptx", "x.pptx"] and new.select("deck_id").distinct().count() == 3


def test_a_batch_is_read_once(spark, tmp_path):
    """The plans of all results start from the written batch, not from its source."""
    source = tmp_path / "source"
    spark.createDataFrame([(1, 1, 10, "a", 3, "s", "x.pptx")], FILES).write.parquet(str(source))
    versions = spark.createDataFrame([("k",)], "hash string")
    accepted, rejected = C.gate_files(spark.read.parquet(str(source)), versions)
    for df in (accepted, rejected):
        plan = df._jdf.queryExecution().toString()
        assert str(source) not in plan and "Join" not in plan
    assert accepted.count() == 1


# --- one file per version -------------------------------------------------------------------------


def test_one_file_per_version(spark, tmp_path):
    text = json.dumps({"slides": [], "nota": "ñandú 中 +%20"}, ensure_ascii=False)
    rows = [("s 1/deck ü_v1.pptx", text), ("s 1/deck ü_v2.pptx", text), ("/x.y+z.pptx", "{}"), ("plain", None)]
    df = spark.createDataFrame(rows, "path string, result string").repartition(3)
    AN.write_analyses(df, str(tmp_path))
    names = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert names == {"s 1/deck ü_v1_analysis.json", "s 1/deck ü_v2_analysis.json", "x.y+z_analysis.json", "plain_analysis.json"}
    assert (tmp_path / "s 1/deck ü_v1_analysis.json").read_text(encoding="utf-8") == text
    back = {r.path: r.result for r in AN.read_analyses(spark, str(tmp_path)).collect()}
    assert back == {"s 1/deck ü_v1": text, "s 1/deck ü_v2": text, "x.y+z": "{}", **({"plain": ""} if "plain" in back else {})}
    # A new analysis of a version replaces the old one; others stay.
    AN.write_analyses(spark.createDataFrame([("s 1/deck ü_v2.pptx", '{"slides":[1]}')], "path string, result string"), str(tmp_path))
    again = {r.path: r.result for r in AN.read_analyses(spark, str(tmp_path)).collect()}
    assert again["s 1/deck ü_v2"] == '{"slides":[1]}' and again["s 1/deck ü_v1"] == text


def test_repeated_and_failed_tasks_leave_nothing(spark, tmp_path):
    from types import SimpleNamespace

    folder = f"file://{tmp_path}"
    rows = [SimpleNamespace(path=f"a/{i}.pptx", result=str(i)) for i in range(3)]
    writer = VF.Writer(folder)
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))  # a killed attempt and its repetition
    assert not list(tmp_path.glob("a/*"))
    writer.commit([kept, None])
    assert sorted(p.name for p in tmp_path.rglob("*.json")) == [f"{i}_analysis.json" for i in range(3)]
    assert lost.attempt != kept.attempt and not list(tmp_path.glob("_staging*"))
    failed = VF.Writer(folder)
    failed.write(iter([SimpleNamespace(path="b.pptx", result="x")]))
    failed.abort([None])
    assert not list(tmp_path.glob("_staging*")) and not list(tmp_path.glob("b*"))
    # A failing job: nothing is published.
    df = spark.range(20).select(
        F.format_string("c/%d.pptx", "id").alias("path"),
        F.when(F.col("id") == 19, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("result"))
    with pytest.raises(Exception, match="stop"):
        AN.write_analyses(df, str(tmp_path))
    assert not list(tmp_path.glob("c"))
    with pytest.raises(ValueError):
        VF.target("../x.pptx")


def test_files_are_read_by_few_tasks(spark, tmp_path):
    """Every file counted as 4 MB, and the driver listed them; a text of several lines came back as several rows."""
    rows = [(f"s {i % 3}/d{i}.pptx", f'{{"n":\n{i}}}') for i in range(300)] + [("_hidden/x.pptx", "{}"), ("empty", None)]
    AN.write_analyses(spark.createDataFrame(rows, "path string, result string").repartition(4), str(tmp_path))
    back = AN.read_analyses(spark, f"file://{tmp_path}")
    assert "FileScan" not in back._jdf.queryExecution().executedPlan().toString()
    assert {r.path: r.result for r in back.collect()} == {p.removesuffix(".pptx"): t for p, t in rows[:300]}
    assert back.count() == 300
