"""Line dedup: which lines recur."""

import numpy as np
import pytest

from decklens.llm import line_dedup


@pytest.fixture(scope="module")
def left(spark):
    """The lines that each text keeps; documents are numbered from 0."""

    def run(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.text.split("\n") if r.text else [] for r in line_dedup.dedup_lines(rows).orderBy("doc_id").collect()]

    return run


def test_last_field_of_five_tokens(left):
    assert left(["User logged in as alice", "User logged in as bob", "User logged out as eve"]) == [
        ["User logged in as alice"], [], ["User logged out as eve"]]


def brute(texts):
    """Lines kept: no line of an earlier document has the same leaf and agrees in 80 % of the places."""
    cut = [[["<*>" if any(c in "0123456789" for c in w) else w for w in line.split()] for line in t.split("\n")] for t in texts]

    def alike(x, y):
        return x == y or len(x) == len(y) and x[:4] == y[:4] and 5 * sum(a == b for a, b in zip(x, y)) >= 4 * len(x)

    return [[t for x, t in zip(cut[i], texts[i].split("\n")) if not any(alike(x, y) for d in cut[:i] for y in d)] for i in range(len(texts))]


def test_all_lines_of_agreeing_places(left):
    rng = np.random.default_rng(2)
    texts = []
    for i in range(120):
        lines = []
        for _ in range(6):
            n = int(rng.choice([4, 5, 6, 9, 10, 14, 15, 20, 33]))
            words = [f"f{'abc'[p % 3]}" for p in range(n)]
            for p in rng.integers(4, max(n, 5), int(rng.integers(0, n // 4 + 2))):
                if p < n:
                    words[p] = "pqrst"[rng.integers(5)] * 2
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    want = brute(texts)
    assert left(texts) == want and 0 < sum(map(len, want)) < 720


def test_more_documents_never_unsettle_a_line(left):
    # Two variable fields: over all documents each value occurs several times.
    texts = [f"the job of user u{a} ended on host {b}h with code x" for a, b in zip("abcdabcdbadc", "efghfehgefgh")]
    some, more = left(texts[:4]), left(texts)
    assert some == [[texts[0]], [], [], []] and more == [[texts[0]], *[[]] * 11]


@pytest.mark.parametrize("block", [3, 1000])
def test_unlike_lines_that_share_a_block(left, monkeypatch, block):
    """Long lines with the same boilerplate, else unlike: all stay but those that a copy with few changes repeats."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    shared = [f"boiler{c}" for c in "abcdefghij"]
    texts = [" ".join(["same", "four", "first", "words", *shared, *(f"own{'xyz'[rng.integers(3)]}{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + k)}" for k in range(16))]) for i in range(60)]
    for i in (5, 17):
        words = texts[i].split()
        for p in (7, 20, 25):
            words[p] = "changed"
        texts.append(" ".join(words))
    got = left(texts)
    assert got == brute(texts) and sum(map(len, got)) == 60


def test_blocks_return_a_row_per_line_at_most(spark):
    n, size = 800, 26
    rng = np.random.default_rng(0)
    rows = [(1, 1, 1, i, (False, i, i), True, rng.integers(0, 2**62, size).astype(np.uint64).tobytes()) for i in range(n)]
    rows += [(1, 1, 1, n + i, (False, n + i, 0), True, rows[i][6]) for i in range(100)]
    members = spark.createDataFrame(rows, "leaf long, key long, cuts int, line long, doc struct<none:boolean,id:long,key:long>, open boolean, tokens binary")
    got = line_dedup.agreeing_in_blocks(members, 4, 0.8).collect()
    assert sorted(r.line for r in got) == list(range(n, n + 100))
    cut = line_dedup.agreeing_in_blocks(members.withColumn("cuts", members.cuts * 4), 4, 0.8).collect()
    assert sorted(r.line for r in cut) == list(range(n, n + 100))
