"""Row counts of the pipeline's stages: one of each class, all copies of the mix, edge rows in every stage."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from decklens.llm import bpe, line_dedup, mixing, near_dup, quality
from decklens.llm.common import table

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def near(k):
    return f"{BASE} end{k}"


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_one_row_of_each_class(spark, monkeypatch, broadcast):
    monkeypatch.setattr("decklens.llm.common.BROADCAST_BYTES", broadcast)
    nameless = frame(spark, [(None, near(k), "a") for k in range(3)])
    assert near_dup.keep_one(nameless).count() == 1
    shared = frame(spark, [(1, near(0), "a"), (1, near(1), "a"), (2, near(2), "a")])
    (kept,) = near_dup.keep_one(shared).collect()
    assert kept.doc_id == 1
    repeated = frame(spark, [(7, near(0), "a")] * 3 + [(7, near(0), "b"), (8, near(1), "a"), (None, near(2), "a"), (9, "other text", "a"), (None, None, "a"), (None, "", "a")])
    got = near_dup.keep_one(repeated).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["7", "9", "None"]
    assert near_dup.keep_one(repeated.select("text", "doc_id")).count() == 3
    assert near_dup.keep_one(repeated.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(rows):
    """Links between all pairs by plain set Jaccard (no shingle repeats in these texts), closed."""
    bags = [set(shingles(t)) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or (bags[i] and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])):
                part = [part[j] if p == part[i] else p for p in part]
    least = {}
    for (d, _), p in zip(rows, part):
        least[p] = min(least.get(p, d), d)
    return {d: least[p] for (d, _), p in zip(rows, part)}


@pytest.mark.parametrize("block", [1000, 7])
def test_near_copies_that_differ_in_places(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(120)]
        for k in range(40):
            own = list(words)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 4, 9])):
                own[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_block_returns_fewer_links_than_members(spark):
    """Near copies that differ in 3 of 200 words: most pairs are candidates, few come out."""
    for n in (100, 400):
        rng = random.Random(n)
        rows = []
        for k in range(n):
            own = [f"w{i}" for i in range(200)]
            for at in rng.sample(range(200), 3):
                own[at] = f"x{rng.randrange(10**9)}"
            rows.append((k, " ".join(own)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        node = F.xxhash64("text").alias("node")
        keys = near_dup.signed(df.select("doc_id", node, "text"))
        bags = near_dup.shingled(df.select(node, "text"))
        members = keys.join(bags, "node").select(
            F.lit(1).alias("bucket"), F.lit(0).alias("band"), F.lit(1).alias("cuts"), "node", F.col("node").alias("component"), "keys", "sketch", "codes", "weights")
        assert 0 < near_dup.linked_in_blocks(members, 0.8).count() <= n - 1


def test_recall_on_the_corpus(spark):
    """Links of a small corpus by an inverted index of all shingles, against the classes."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dup.classes(table(spark, SF, "documents")).collect()}
    bags = [shingles(t) for _, t in rows]
    links = hit = 0
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[i] == bags[j] or (len(set(bags[i]) & set(bags[j])) >= 0.8 * len(set(bags[i]) | set(bags[j])) and bags[i] and max(bags[i].values()) == max(bags[j].values()) == 1):
                links += 1
                hit += got[rows[i][0]] == got[rows[j][0]]
    assert links > 5 and hit == links


@pytest.mark.parametrize("many", [1 << 14, 2])
def test_mix_returns_as_many_rows_as_copies(spark, monkeypatch, many):
    monkeypatch.setattr(mixing, "MANY", many)
    two_sources = [(1, "a b c d e", s) for s in ("a", "b")] + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(2, 40)]
    repeats = [(5, "x y z", "a")] * 7 + [(i, "q " * 3, None) for i in range(10)] + [(None, "x y z", "a")] * 3 + [(None, None, None)] * 2
    for rows in (two_sources, repeats, [(None, None, None)], []):
        df = frame(spark, rows)
        taken = Counter()
        for r in mixing.mix(df).collect():
            taken[r.doc_id, r.source, r.text_key] += r.copies
        got = mixing.mixed_documents(df).withColumn("key", mixing.shuffle_key(17)).collect()
        assert Counter((r.doc_id, r.source, r.key) for r in got) == +taken
    # Rows of one text with other columns that differ take turns.
    df = spark.createDataFrame([(1, "a b", "s", i) for i in range(4)] + [(2, "c " * 50, "t", 0)], "doc_id long, text string, source string, extra int")
    got = Counter(r.extra for r in mixing.mixed_documents(df).filter("doc_id = 1").collect())
    assert not got or max(got.values()) - min(got[i] for i in range(4)) <= 1


EDGE = [
    (1, near(0), "a"), (1, near(0), "a"), (2, near(1), "a"), (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (None, "zz top", "c"), (None, None, None),
    (6, "word " * 30_000, "a"), (7, "shared line of the corpus here\nown\nshared line of the corpus here", "ü"), (8, "shared line of the corpus here\nother own words", "ü"),
]


def test_stages_on_edge_rows_and_nothing(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (EDGE, []):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame(spark, rows), SF)
            assert out.columns == columns, name
            assert out.count() <= 3 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, frame(spark, rows), SF).count() == len(rows)


def test_line_stage_recounts_characters(spark):
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, frame(spark, EDGE), SF).collect() if r.doc_id in (7, 8)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    kept = [line for r in got.values() for line in r.text.split("\n")]
    # The first document keeps the line with its repeat.
    assert kept.count("shared line of the corpus here") == 2 and {"own", "other own words"} <= set(kept) and got[8].text == "other own words"
    again = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, EDGE)).filter("doc_id in (7, 8)").collect()}
    assert again == {(r.doc_id, r.text) for r in got.values()}


def test_quality_and_encoding_stages(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    judged = quality.judge(docs.select("doc_id", "text"), quality.train(docs.select("doc_id", "text"), table(spark, SF, "labels"))).collect()
    assert kept == {r.doc_id for r in judged if r.kept} and 0 < len(kept) < len(judged)
    enc = bpe.encoding()
    rows = [(1, "héllo wörld\n", "a"), (2, None, None), (2, "x", "b")]
    got = corpus_pipeline.encoding_stage(spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id, r.source, r.ids) for r in got if r.source) == [(1, "a", enc.encode_ordinary("héllo wörld\n")), (2, "b", enc.encode_ordinary("x"))]
    assert [r.n_tokens for r in got if r.source is None] == [0]
