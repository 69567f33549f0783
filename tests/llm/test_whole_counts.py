"""LM scoring models every word and bigram of the corpus, however many there are."""

from collections import Counter

import numpy as np
import pytest

from decklens.llm import lm_scoring


def test_scores_of_rare_words_and_bigrams(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # 60,000 words that occur once, in as many documents a frequent word and rare words twice.
    texts = [" ".join([f"W{i}x{k} the" for k in range(2000)]) for i in range(30)] + [f"the W{i}x7 w{i}x8 a a the" for i in range(30)]
    rows = [(i, texts[k]) for i, k in enumerate(rng.permutation(len(texts)))] + [(99, None), (100, " "), (101, texts[3])]
    target = [r for r in rows if r[0] % 3 == 0]
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 50_000, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, spark.createDataFrame(target, docs.schema)).collect()}

    split = {i: (t or "").lower().split() for i, t in rows}

    def counts(ids):
        words, before, pairs = Counter(), Counter(), Counter()
        for i in ids:
            words.update(split[i])
            before.update(split[i][:-1])
            pairs.update(zip(split[i], split[i][1:]))
        return words, before, pairs

    models = [counts(r[0] for r in target), counts(split)]
    size, total = len(models[1][0]), models[0][0].total()
    assert len(got) == len(rows) and size > 60_000
    for i, w in split.items():
        means = []
        for words, before, pairs in models:
            scale, loss = total / words.total(), 0.0
            for a, b in zip([None, *w], w):
                p = (words[b] * scale + lm_scoring.ALPHA) / (total + lm_scoring.ALPHA * size)
                loss -= np.log(p if a is None else (pairs[a, b] * scale + lm_scoring.MU * p) / (before[a] * scale + lm_scoring.MU))
            means.append(loss / len(w) if w else None)
        r = got[i]
        assert r.n_tokens == len(w)
        want = (*means, means[0] - means[1]) if w else (None,) * 3
        assert (r.target_loss, r.background_loss, r.score) == (pytest.approx(want) if w else want)


def test_rows_of_a_block_are_sealed(spark):
    """Rows of a block were stored, and went to their sums, as Spark packs them, half as large again."""
    import random

    pick = random.Random(1)
    syllables = ["ca", "men", "to", "sol", "ri", "ña", "pre", "dor", "al", "qui"]
    rows = [(i if i else None, None if i == 3 else " ".join("".join(pick.choices(syllables, k=3)) for _ in range(300)), [i, None]) for i in range(200)]
    blocks = lm_scoring.blocked(spark.createDataFrame(rows, "doc_id long, text string, more array<int>").coalesce(1)).collect()
    raw = sum(len((t or "").encode()) for _, t, _ in rows)
    assert sum(r.bytes for r in blocks) == raw and sum(len(r.rows) for r in blocks) < raw / 2
    back = [r for b in blocks for r in lm_scoring.opened(bytes(b.rows)).to_pylist()]
    assert sorted(((r["doc_id"], r["text"], r["more"]) for r in back), key=str) == sorted(rows, key=str)
