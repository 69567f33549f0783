"""op9 sends codes of the vectors to its blocks, few bytes a vector however many share a label, and links the same."""

import os
import threading
from contextlib import contextmanager, suppress

import numpy as np
import pytest

from decklens.llm import common, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(vectors, label=lambda i: 0):
    return [(i, [float(v) for v in e], label(i)) for i, e in enumerate(vectors.astype(np.float32))]


@contextmanager
def disk(spark):
    """The most bytes that new files of shuffles and staged tables have at a time; shuffles go as soon as they are read."""
    tops = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.conf.get("spark.checkpoint.dir")]
    peak, over = [0], threading.Event()

    def sizes():
        found = {}
        for path in (f"{d}/{name}" for top in tops for d, _, names in os.walk(top) for name in names):
            with suppress(OSError):
                found[path] = os.path.getsize(path)
        return found

    before = sizes()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], sum(size for path, size in sizes().items() if path not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        yield peak
    finally:
        over.set()
        watcher.join()


def brute(rows):
    """(n_links, component_id) of each row that has a usable vector, by all pairs."""
    out = {}
    for label, dim in {(r[2], len(r[1])) for r in rows}:
        own = [r for r in rows if r[2] == label and len(r[1]) == dim]
        u = np.array([r[1] for r in own])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= embedding_dedup.COSINE
        np.fill_diagonal(near, False)
        first = np.array([r[0] for r in own])
        while True:
            reached = np.minimum(first, np.where(near, first[None], first.max()).min(1))
            if (reached == first).all():
                break
            first = reached
        out |= {r[0]: (int(near[k].sum()), int(first[k])) for k, r in enumerate(own)}
    return out


def linked(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_disk_of_one_label(spark, tmp_path):
    rng = np.random.default_rng(4)
    for n in (3000, 6000):
        spark.createDataFrame(rows_of(rng.standard_normal((n, 64))), SCHEMA).write.parquet(f"{tmp_path}/{n}")
        with disk(spark) as peak:
            assert embedding_dedup.near(spark.read.parquet(f"{tmp_path}/{n}")).count() == n
        assert 0 < peak[0] <= 4 * n * 64 * 4


def test_links_when_cells_and_sets_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((25, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    # Near copies whose distances lie around the bound, random vectors, a chain, copies, and other lengths.
    near = centres[rng.integers(0, 25, 900) ** 2 // 25] + rng.standard_normal((900, 64)) * 0.018
    angle = np.arange(300) * 0.15
    chain = np.zeros((300, 64))
    chain[:, 0], chain[:, 1], chain[:, 2] = np.cos(angle), np.sin(angle), np.arange(300) * 0.02
    rows = rows_of(np.concatenate((near, rng.standard_normal((900, 64)), chain)), lambda i: int(i % 7 == 0))
    rows += [(5000 + i, *rows[i][1:]) for i in range(0, 1000, 3)] + [(6000 + i, [float(np.float32(v)) for v in rng.standard_normal(3)], 0) for i in range(300)]
    expected = brute(rows)
    assert sum(n for n, _ in expected.values()) > 5000
    assert linked(spark, rows) == expected
    # Cells of 64 vectors and parts of 128; small labels and sets in packs of 50; no measured side is broadcast.
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for name, value in (("CELL", 1 << 12), ("SEEN", 16), ("PART", 1 << 13), ("PACK", 50)):
        monkeypatch.setattr(embedding_dedup, name, value)
    assert linked(spark, rows) == expected


def test_no_usable_vector(spark):
    assert embedding_dedup.near(spark.createDataFrame([], SCHEMA)).count() == 0
    assert linked(spark, [(1, None, 0), (2, [0.0, 0.0], 0), (3, [], 0), (4, [1.0], None)]) == {i: (0, i) for i in range(1, 5)}


@pytest.mark.parametrize("dim", [1, 3, 8, 64, 100])
def test_every_pair_in_range_meets(dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((500, dim))
    unit = embedding_dedup.units(np.concatenate((base, base + rng.standard_normal((500, dim)) * 0.14)))
    a, b = np.nonzero(np.triu(unit @ unit.T >= embedding_dedup.COSINE, 1))
    assert len(a)
    code, joined = embedding_dedup.codes(embedding_dedup.rotated(unit)), np.zeros(len(a), bool)
    for block in embedding_dedup.blocks(dim):
        root = embedding_dedup.forest(code, block, embedding_dedup.COSINE)
        joined |= root[a] == root[b]
        x, reach = code[:, block].astype(np.float32), embedding_dedup.budget(embedding_dedup.COSINE, block, dim) ** 0.5 * embedding_dedup.steps(dim) + 1
        cells = [set(rows) for _, _, rows in embedding_dedup.walk(embedding_dedup.cut(x[::4], 4, reach, 100, 0.9), x, np.arange(len(x)), reach)]
        within = np.flatnonzero((abs(x[a] - x[b]) <= reach).all(1))
        assert all(any(a[p] in c and b[p] in c for c in cells) for p in within)
    assert joined.all()
