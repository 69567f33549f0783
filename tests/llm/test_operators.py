"""The corpus operators against brute force, exact round trips and held-out accuracy; edge rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklens.llm import bpe, embedding_dedup, language, licenses, line_dedup, lm_scoring, mixing, near_dup, quality, token_files
from decklens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
#: Null ids, null, empty and blank texts, repeated rows, a very long text, a clashing column.
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nAll rights reserved.", "en", "a", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nAll rights reserved.", "en", "a", 1),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappb\n\nAll rights reserved.\nown line", "en", None, 2),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 4), (None, "zz top", None, "c", 6), (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)), (7, "12 <*> 中文 ñandú 'll\x1c x", "es", "ü", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def brute_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    filled = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(filled) - len(set(filled)), len(covered)]


def test_quality(spark, docs, edge, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.train(docs, labels)
    for rows in (docs, edge.withColumn("kept", F.lit(7))):
        for r in quality.judge(rows, forest).collect():
            b = brute_statistics(r.text)
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == b
            assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.base_failed and r.kept)
    assert quality.judge(none, quality.train(none, labels)).count() == 0
    x = np.random.default_rng(0).random((400, 2))
    f = quality.fit_forest(x, (x[:, 0] + x[:, 1] > 1).astype(float), [1, 0])
    p = f.probability(np.c_[np.linspace(0, 1, 50), np.full(50, 0.5)])
    assert (np.diff(p) >= 0).all() and p[-1] > 0.9 > 0.1 > p[0]


def test_mixing(spark, docs, edge, none):
    first, again = (sorted(mixing.mix(docs).drop("text_key").collect()) for _ in range(2))
    assert first == again
    assert sum(r.taken for r in first) <= sum(r["size"] for r in first)
    assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in first)
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # Weights 1, 2, 3, 1: c is capped at 0, null at 3, a takes one third of the rest unless capped at 30.
    assert got[None] == 3 and got["c"] == 0 and got["a"] == 30 and got["b"] == pytest.approx(78)


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (50, 40), (64, 8)])
def test_bpe(docs, edge, none, chunk, overlap):
    enc = bpe.encoding()
    for rows in (docs.limit(60), edge):
        got = bpe.encode(rows, chunk=chunk, overlap=overlap).select("text", "n_tokens", "ids", bpe.ids_digest("ids").alias("h"), bpe.decode("ids").alias("raw")).collect()
        for r in got:
            ids = enc.encode_ordinary(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.raw) == (r.text or "").encode()
            assert r.h == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(none).count() == 0


def test_token_files(docs, edge, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.TOKENIZER)
    for rows in (docs, edge):
        order = sorted(rows.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        got = token_files.stored(rows, crc=True).orderBy("start").collect()
        start = 0
        for r, d in zip(got, order, strict=True):
            ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (d.doc_id, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_files.stored(none).count() == 0
    rng = np.random.default_rng(0)
    for values in (np.zeros(5000), rng.integers(0, 50257, 9999), np.where(rng.random(5000) < 0.01, 2**32 - 1, rng.integers(0, 100, 5000))):
        v = values.astype(np.uint32)
        packed = token_files.encode_segment(v, 512)
        assert (token_files.decode_segment(packed) == v).all() and (token_files.decode_segment(packed, 700, 1300) == v[700:1300]).all()


def test_language(docs, edge, none):
    found = language.predict(docs, language.train(docs)).withColumn("held_out", language.held_out()).collect()
    held = [r for r in found if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    model = language.train(docs)
    marks = {r.text: r.lang_pred for r in language.predict(edge, model).collect()}
    assert marks[None] == marks[""] == "und" and marks[LONG] != "und"
    assert language.predict(none, language.train(none)).count() == 0


def test_licenses(edge, none):
    cases = {
        "x.\nLicensed under CC BY-NC 4.0.\ny": ["CC-BY-NC-4.0"], "Released under the MIT License.": ["MIT"],
        "GNU General Public License version 2, or any later version.": ["GPL-2.0-or-later"],
        "Licensed under the Foo License.": ["Unrecognised"], "plain text": [], "": [],
    }
    for text, want in cases.items():
        assert licenses.match_rules(licenses.sentence_ids(text)) == want
    got = [r.licenses for r in licenses.scan(edge).orderBy("doc_id").collect() if r.doc_id == 1]
    assert got == [["All-Rights-Reserved"]] * 2 and licenses.scan(none).count() == 0


def test_line_dedup(edge, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(edge).collect() if r.doc_id}
    assert got[1].n_dropped == 0 and got[2].text == "\nown line" and got[2].n_dropped == 2
    assert got[3].text is None and got[6].text == LONG and line_dedup.dedup_lines(none).count() == 0


def test_line_fields(spark):
    rows = [(i, f"job {i} of user u{chr(97 + i)} ended on host h with code x") for i in range(4)] + [(9, "job 9 of nothing else that is like it at all here")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] and got[9] and not any(got[i] for i in (1, 2, 3))


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = (t or "").lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    part = {i: i for i, _ in rows}

    def similar(x, y):
        both = set(x) | set(y)
        return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in both) for d in set(x) & set(y))

    for a, ta in rows:
        for b, tb in rows:
            if a < b and (ta == tb or (set(bags[a]) & set(bags[b]) and similar(bags[a], bags[b]) >= 0.8)):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return part


def test_near_dup(spark, edge, none):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 300, 80)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = base[k % 12].split()
        for at in rng.integers(0, 80, k % 5):
            words[at] = f"n{rng.integers(0, 999)}"
        rows.append((100 + k, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert near_dup.classes(edge).count() == len(EDGE) and near_dup.keep_one(none).count() == 0
    assert near_dup.keep_one(edge).filter("doc_id = 1").count() == 1


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + rng.standard_normal((100, 16)) * 0.15
    rows = [(i, [float(v) for v in e], int(i % 3 == 0)) for i, e in enumerate(x.astype(np.float32))]
    rows += [(900, rows[0][1], 1), (901, [0.0] * 16, 1), (902, None, 1), (903, [float("nan")] * 16, 0), (904, rows[0][1], None), (905, [None] * 16, 0)]
    got = {r.vec_id: r for r in embedding_dedup.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    use = [r for r in rows if r[0] <= 900]
    u = np.array([r[1] for r in use], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([r[2] for r in use])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert near.any()
    for k, r in enumerate(use):
        assert got[r[0]].n_links == near[k].sum()
        reach, now = {k}, {k}
        while now:
            now = {j for i in now for j in np.flatnonzero(near[i])} - reach
            reach |= now
        assert got[r[0]].component_id == min(use[j][0] for j in reach)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(901, 906))


def test_lm_scoring(edge, none, spark):
    rows = [(i, "a b a b a b a b") for i in range(20)] + [(100 + i, "c d e c d e c d") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm_scoring.score(docs, docs.filter("doc_id < 10")).collect()}
    assert score[0] < 0 < score[100]
    shared, target, background = lm_scoring.train(docs, docs)
    assert np.exp(-target.word_loss).sum() == pytest.approx(1) and np.allclose(target.word_loss, background.word_loss)
    got = lm_scoring.score(edge, edge.filter("doc_id = 1")).collect()
    assert len(got) == len(EDGE) and all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert lm_scoring.score(none, none).count() == 0
