"""Term vectors and the cosine between consecutive slides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens.functions import numeric as N
from decklens.functions import text as X
from decklens.operators import ordered as O

#: slide numbers of a deck that are compared in one task
BLOCK = 64


def term_frequency(slides: DataFrame) -> DataFrame:
    """``(deck_id, slide_number, term, n, tf)``: occurrences and share of each term of a slide.

    Slides are spread by (deck, slide) first: the text travels once, in compact form. The terms of a slide that
    stands in one row are counted inside the row, so a task holds texts, not terms. Only rows that share their
    number are exploded before they are counted; a window holds the distinct terms of one slide then.
    """
    keys = ["deck_id", "slide_number"]
    text = X.joined_text(F.col("title"), F.col("content"))
    rows = (
        slides.select(*keys, text.alias("text"))
        .repartition(*keys)
        .withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    )
    # (The outer form of explode: the plain form adds a filter, which would count the terms twice.)
    found = rows.filter("rows = 1").select(*keys, F.explode_outer(X.term_counts(X.narrative_terms(F.col("text")))).alias("c"))
    alone = found.filter(F.col("c").isNotNull()).select(*keys, "c.*")
    terms = rows.filter("rows > 1").select(*keys, F.explode_outer(X.narrative_terms(F.col("text"))).alias("term"))
    counted = terms.filter(F.col("term").isNotNull()).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return alone.unionByName(counted.withColumn("tf", F.col("n") / total))


def renumbered(slides: DataFrame, block: int = 10_000) -> DataFrame:
    """Slides whose numbers have gaps, with ``place`` = 1, 2, 3, ... in their order."""
    cut = F.floor(F.col("slide_number") / block)
    return O.dense_number(slides, ["deck_id"], ["slide_number"], cut, "place")


def _groups(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """First places of the runs of equal keys."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        codes = pc.dictionary_encode(rows.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if rows.num_rows else np.zeros(0, np.int64)


def _products(rows: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of rows (block, slide_number, terms): whether a run follows its neighbour, the dot
    product of their term counts, and the squared norm of its own. The terms of a run are one vector."""
    n = len(first)
    decks = pc.dictionary_encode(rows.column("deck_id").combine_chunks(), null_encoding="encode").indices.to_numpy()[first]
    block, slide = (rows.column(c).to_numpy()[first] for c in ("block", "slide_number"))
    follows = np.zeros(n, bool)
    follows[1:] = (decks[1:] == decks[:-1]) & (block[1:] == block[:-1]) & (slide[1:] == slide[:-1] + 1)
    terms = rows.column("terms").combine_chunks()
    run = np.repeat(np.searchsorted(first, np.arange(rows.num_rows), "right") - 1, terms.value_lengths().to_numpy())
    hashes = terms.flatten().to_numpy()
    order = np.lexsort((hashes, run))
    hashes, run = hashes[order], run[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (run[1:] != run[:-1])])) if len(run) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(run))).astype(float)
    hashes, run = hashes[new], run[new]
    # Each vector meets the next one's under the next one's number.
    ahead = np.append(follows[1:], False)[run]
    both_run, both_hash = np.concatenate([run, run[ahead] + 1]), np.concatenate([hashes, hashes[ahead]])
    both_count = np.concatenate([count, count[ahead]])
    order = np.lexsort((both_hash, both_run))
    both_run, both_hash, both_count = both_run[order], both_hash[order], both_count[order]
    met = np.flatnonzero((both_run[1:] == both_run[:-1]) & (both_hash[1:] == both_hash[:-1]))
    dot = np.bincount(both_run[met], both_count[met] * both_count[met + 1], n)
    # (numpy counts nothing as whole numbers)
    return follows, dot.astype(float), np.bincount(run, count * count, n).astype(float)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deck_id, slide_number, dot, here_sq, before_sq, follows) of slides sorted by deck, block and number.

    The last two runs of a batch wait for the next batch: the last may go on there, and its predecessor is
    its neighbour.
    """
    keys = ["deck_id", "block", "slide_number"]

    def told(rows: pa.Table, first: np.ndarray, start: int, end: int) -> pa.RecordBatch:
        follows, dot, square = _products(rows, first)
        own = rows.column("own").to_numpy()[first]
        at = np.arange(start, end)[own[start:end]]
        taken = rows.select(["deck_id", "slide_number"]).take(pa.array(first[at])).combine_chunks()
        before = np.where(follows[at], square[at - 1], 0.0)
        found = [pa.array(x) for x in (dot[at], square[at], before, follows[at])]
        columns = [taken.column(c).combine_chunks() if taken.num_rows else pa.array([], taken.schema.field(c).type) for c in taken.column_names]
        return pa.RecordBatch.from_arrays([*columns, *found], ["deck_id", "slide_number", "dot", "here_sq", "before_sq", "follows"])

    held, start = None, 0
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = rows if held is None else pa.concat_tables([held, rows])
        first = _groups(rows, keys)
        if len(first) > 1:
            yield told(rows, first, start, len(first) - 1)
            held, start = rows.slice(int(first[-2])), 1
        else:
            held = rows
    if held is not None and held.num_rows:
        first = _groups(held, keys)
        yield told(held, first, start, len(first))


def previous_similarity(slides: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sim_previous`` (null on a deck's first slide) and ``sim_average`` (1.0 there), 4 decimals.

    The neighbour is the slide numbered one lower, whatever its type; number slides with gaps by
    :func:`renumbered` first. Terms are hashed and sorted where the texts are read, so no text is shuffled. A deck is cut into
    blocks of ``block`` numbers, which spread even one enormous deck over all tasks, and only the last slide of
    a block is sent to the next block as well. Blocks are sorted, and each slide meets the one before it. Dot product and
    norms are whole numbers, hence exact in any order.
    """
    text = X.joined_text(F.col("title"), F.col("content"))
    terms = F.transform(X.narrative_terms(text), lambda t: F.xxhash64(t))
    own = F.floor((F.col("slide_number") - 1) / block)
    goes = F.when(F.pmod(F.col("slide_number"), F.lit(block)) == 0, F.array(own, own + 1)).otherwise(F.array(own))
    placed = (
        slides.select("deck_id", "slide_number", terms.alias("terms"))
        .withColumn("block", F.explode(goes))
        .select("deck_id", "block", "slide_number", (F.col("block") == own).alias("own"), "terms")
        .repartition("deck_id", "block")
        .sortWithinPartitions("deck_id", "block", "slide_number")
    )
    kinds = T.StructType([placed.schema["deck_id"], placed.schema["slide_number"]])
    for name in ("dot", "here_sq", "before_sq"):
        kinds = kinds.add(name, "double")
    met = placed.mapInArrow(_neighbours, kinds.add("follows", "boolean"))
    norm = F.sqrt("before_sq") * F.sqrt("here_sq")
    raw = met.withColumn(
        "cosine", F.when(F.col("dot") > 0, F.col("dot") / norm).otherwise(F.lit(0.0))
    )
    rounded = N.py_round(F.col("cosine"), 4)
    return raw.select(
        "deck_id",
        "slide_number",
        F.when(F.col("follows"), rounded).alias("sim_previous"),
        F.when(F.col("follows"), rounded).otherwise(F.lit(1.0)).alias("sim_average"),
    )
