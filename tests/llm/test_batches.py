"""Slices of Arrow batches, and the session's batch setting around staged tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from decklens.llm.common import _BATCH_SETTING, BATCH_BYTES, bound_batches, pieces, slices, staged

TEXTS = [None, "", "abc", "x" * 50, "", None, "defgh", "y"]


@pytest.mark.parametrize("size", [1, 8, 1000])
@pytest.mark.parametrize("rows", [None, 1, 3])
def test_pieces_keep_all_rows_in_order(size, rows):
    cut = list(pieces(pa.array(TEXTS), size, rows))
    assert [t for p in cut for t in p.to_pylist()] == TEXTS
    assert all(len(p) and (rows is None or len(p) <= rows) for p in cut)
    batch = pa.record_batch({"text": pa.array(TEXTS), "n": pa.array(range(len(TEXTS)))})
    assert [n for b in slices(iter([batch]), "text", size, rows) for n in b.column("n").to_pylist()] == list(range(len(TEXTS)))


def test_pieces_of_nothing():
    assert list(pieces(pa.array([], pa.string()), 8, 2)) == []


def test_staged_restores_the_setting(spark):
    before = spark.conf.get(_BATCH_SETTING)
    assert staged(spark.range(10)).count() == 10
    assert spark.conf.get(_BATCH_SETTING) == before
    with pytest.raises(Exception, match="stop"):
        staged(spark.range(1).select(F.raise_error(F.lit("stop")).alias("x")))
    assert spark.conf.get(_BATCH_SETTING) == before
    bound_batches(spark)
    try:
        assert spark.conf.get(_BATCH_SETTING).startswith(str(BATCH_BYTES))
    finally:
        spark.conf.set(_BATCH_SETTING, before)
