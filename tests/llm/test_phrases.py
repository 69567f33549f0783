"""Phrases by sample and border against counting every phrase; border failures, edge rows."""

import random
import re
from collections import Counter

import pytest

from decklens.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, phrase int, n string"


def brute_frequent(rows, least):
    """f of every phrase of every language, by plain counting; a phrase is a tuple of words."""
    f = Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, P.WORDS + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
            f[lang or "und", ()] += len(w)
    return {k: v for k, v in f.items() if v >= least}


def brute(rows, least, top):
    f = brute_frequent(rows, least)
    out = []
    for lang in {x for x, _ in f}:
        found = []
        for (x, p), a in f.items():
            if x != lang or len(p) < 2:
                continue
            n = f[lang, ()]
            score, k = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            longer = [v for (y, q), v in f.items() if y == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if max(longer, default=0) < a:
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "x", "ñu", "12", "über", "zz top"]
    ends = [" ", "  ", "\t", " ", ", ", ".\n", "! ", " "]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text + " New York city hall" * rng.randrange(3), rng.choice(["en", "de", None, "und"]), i, "x"))
    # A language and phrases that no small sample proposes: they come in by failures of the border.
    rows += [(1000 + i, "rare words meet here " * 3, "fr", 0, None) for i in range(10)]
    return rows


EDGE = [
    (None, None, None, None, None), (1, None, "en", 1, "n"), (2, "", "en", 1, "n"), (3, " \t\r\n..,", "en", 1, "n"), (4, "w " * 50_000, "en", 1, "n"),
    (5, "a b", "en", 1, "n"), (5, "a b", "en", 1, "n"), (None, "a b", None, 1, "n"), (6, "A\x0bB\x0cc\x00 d", "e\x00", 1, "n"), (7, "a b", "e", 1, "n"),
]


@pytest.mark.parametrize("sampled,sample_least", [(1, 2), (4, 2), (10**9, 1)])
def test_equals_counting_every_phrase(spark, sampled, sample_least):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, passes = P.frequent(docs, 6, sampled, sample_least)
    assert {(r.lang, tuple(r.phrase.split(" ")) if r.phrase else ()): r.n for r in got.collect()} == brute_frequent(rows, 6)
    assert passes == 1 if sampled == 1 else passes > 1
    best = P.collocations(docs, 6, 15, sampled, sample_least)
    assert sorted(tuple(r) for r in best.collect()) == brute(rows, 6, 15)


def test_small_limits_change_nothing(spark, monkeypatch):
    """Full bitmaps, counts passed on at once in many ranges, and phrases forgotten after each portion."""
    rows = corpus()
    for name, value in (("FILTER_BITS", 7), ("HELD", 1), ("TOLD", 0), ("TOGETHER", 3), ("RANGE_BYTES", 1000)):
        monkeypatch.setattr(P, name, value)
    got = P.collocations(spark.createDataFrame(rows, SCHEMA), 6, 15, 3, 2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6, 15)


@pytest.mark.parametrize("most", [1, 7, 40, 1 << 20])
def test_portions_and_words(most):
    """Buffers of any size give the words, languages and ends of pieces that plain splitting gives."""
    texts = [b"", b"Aa bb", b"x" * 50 + b" y. z\tW,,v \x0b u", b" ", "ñ \u00a0 é\x00 \x1c,".encode(), b"p q r s t. " * 9]
    langs = ["a", "b", "a", "c", "b\0", "b"]
    got, codes = [], {}
    for buffer, starts, numbers in P.portions(texts, most):
        g = P.Grams(buffer, starts, [langs[i] for i in numbers])
        for k in range(len(g.first)):
            word = g.phrase(k, 1)
            got.append((g.names[g.lang[k]], word, int(g.left[k])))
            assert codes.setdefault(word, (g.high[k], g.low[k])) == (g.high[k], g.low[k])
    want = []
    for text, lang in zip(texts, langs):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text.decode())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            want += [(lang, x, len(w) - i) for i, x in enumerate(w)]
    assert got == want and len({c[0] for c in codes.values()}) == len({c[1] for c in codes.values()}) == len(codes)


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    for least in (1, 2, 100):
        assert sorted(tuple(r) for r in P.collocations(docs, least, 50, 2, 1).collect()) == brute(EDGE, least, 50)
    assert P.collocations(docs.limit(0)).collect() == []
    assert P.collocations(docs.filter("doc_id = 5")).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^12 are kept exact."""
    big = 10**12 + 7
    f = [("en", "", 9 * big), ("en", "a", big), ("en", "b", big - 3), ("en", "a b", big - 5)]
    monkeypatch.setattr(P, "frequent", lambda *_: (spark.createDataFrame(f, "lang string, phrase string, n long"), 1))
    (r,) = P.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert r.score == 1000 * (big - 5) * 9 * big // (big * (big - 3))
