"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are put in a shuffled order (hash of seed and row). A copy of a document gets
a virtual finish time: the source's running total of words up to it, over the source's target. All
copies are merged by finish time, and the merged list is cut at the total budget: the targets share the
budget, and every source reaches its own at finish time 1, so the list ends there. Each source takes words in proportion to
its target all along.

No source and no time span is ever ordered in one task: running totals are kept as block totals
(one row per block) and ordered inside a block only; a block holds about ROWS_PER_BLOCK rows. Targets are
worked out in one task, over one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decklens.llm.common import staged

ROWS_PER_BLOCK = 50_000
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Rounds in which each source takes the largest copy left that fits what it still misses.
FILLS = 4
KEY_BITS = 60
#: Copies of one row that a task brings forth at once.
MANY = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """The place of a document in the shuffled order: the first KEY_BITS bits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source, null among them.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total of all
    sizes; a target stops at ``repeats`` times its source's size and the rest is shared by weight
    among the others. That is a water level: sources are filled up in the order of cap per weight,
    and a source is capped when the level of those not yet passed stands above its cap. Windows
    here run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    rows = total.withColumn("_weight", cycle.cast("double")).withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    passed = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(whole).cast("double")
    rows = rows.withColumn("_budget", budget).withColumn(
        "_capped", (F.col("_budget") - passed) / left > F.col("_cap") / F.col("_weight"))
    spent = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(whole)
    level = F.when(open_weight > 0, (F.col("_budget") - spent) / open_weight).otherwise(0.0)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_weight")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _running(rows: DataFrame, keys: list[str], block: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the running total of ``value`` up to each row, in the order of ``block``, then ``order``."""
    cut = rows.withColumn("_block", block)
    sums = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_block").alias("_s_block"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    on = F.col("_block") == F.col("_s_block")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(starts, on)
        .withColumn(name, F.col("_start") + F.sum(value).over(inside))
        .drop("_block", "_start", "_s_block", *[f"_s_{k}" for k in keys])
    )


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, text_key, size, source, source_size, target, copies, taken: one row per document.

    ``copies`` (0 to ``repeats``) is how often the mix takes the document, ``taken`` its words so
    taken. A source never passes its target; the copy that would is left out, and what is then missing is filled with
    the largest copies left that fit, one a round. A null text has size 0; rows without words finish with the row before
    them and are taken wherever the list reaches them. The shuffled order is a hash of seed, doc_id and text, so
    reruns agree; rows equal in doc_id, source and text are interchangeable. Null sources are one
    source. An empty table gives an empty result. Extra columns are not read.
    """
    rows = staged(docs.select(
        "doc_id", "source", word_count().alias("size"), shuffle_key(seed).alias("text_key"), F.monotonically_increasing_id().alias("_n")))
    n = rows.agg(F.count(F.lit(1))).first()[0]
    bits = max(0, (max(n, 1) // ROWS_PER_BLOCK).bit_length())
    order = [F.col("text_key"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    # The top bits of the hash: an equal share of any source to each block, in the order of the hash.
    block = F.shiftright(F.col("text_key"), KEY_BITS - bits)
    targets = source_targets(rows, weights, repeats)
    queued = _running(rows, ["source"], block, order, "size", "_upto")
    t = targets.select(F.col("source").alias("_t_source"), "source_size", "target")
    queued = queued.join(t, F.col("source").eqNullSafe(F.col("_t_source"))).drop("_t_source")
    # Copy e of a document finishes at (e * source size + running total) / target; the list ends at time 1.
    taken = [F.when(F.col("source_size") * e + F.col("_upto") <= F.col("target"), 1).otherwise(0) for e in range(repeats)]
    queued = staged(queued.withColumn("copies", sum(taken[1:], taken[0]).cast("int")))
    filled = queued
    more = None
    for _ in range(FILLS):
        sums = filled.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("_sum"))
        gaps = sums.select(F.col("source").alias("_g_source"), (F.col("target") - F.col("_sum")).alias("_gap"))
        fits = filled.filter((F.col("copies") < repeats) & (F.col("size") > 0)).join(gaps, F.col("source").eqNullSafe(F.col("_g_source")))
        best = F.max(F.struct("size", "text_key", "doc_id", "_n")).alias("b")
        # One row per source.
        chosen = staged(fits.filter(F.col("size") <= F.col("_gap")).groupBy("source").agg(best).select(F.col("b._n").alias("_n")))
        more = chosen if more is None else more.unionByName(chosen)
        extra = more.groupBy("_n").agg(F.count(F.lit(1)).cast("int").alias("_more"))
        filled = queued.join(extra, "_n", "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0))).drop("_more")
    return filled.select(
        "doc_id", "text_key", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _who(doc_id: str = "doc_id", source: str = "source") -> Column:
    flags = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in (doc_id, source)])
    return F.xxhash64(flags, doc_id, source)


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken.

    Rows equal in doc_id, source and text share the copies that the mix takes of them: each gets
    as many as the others, and the first ones, in the order of a hash of their other columns, one more if
    that is what is left. Rows equal throughout travel as one row with a number. What a task orders is one
    row for each different hash under a doc_id, source and text, without the text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))) if others else F.lit(0).cast("long")
    keys = ["_key", "_who"]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), shuffle_key(seed).alias("_key"), _who().alias("_who"), rest.alias("_rest"))
    taken = mix(docs, seed).groupBy(F.col("text_key").alias("_key"), _who().alias("_who")).agg(F.sum("copies").alias("_taken")).filter("_taken > 0")
    alike = keyed.groupBy(*keys, "_rest").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*keys)
    counts = keyed.groupBy(*keys, "_rest").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(by.orderBy("_rest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.select(*keys, "_rest", before.alias("_before"), F.sum("_n").over(by).alias("_all")).join(taken, keys)
    copies = F.expr("_n * (_taken div _all) + greatest(0L, least(_n, _taken % _all - _before))")
    met = alike.join(shares, [*keys, "_rest"]).select("_row", copies.alias("_copies"), "_key", "_who").filter("_copies > 0")
    few = met.filter(F.col("_copies") <= MANY).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    # Very many equal rows are brought forth in parts, by several tasks.
    parts = met.filter(F.col("_copies") > MANY).withColumn("_part", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {MANY})")))
    many = parts.repartition("_key", "_who", "_part").withColumn(
        "_i", F.explode(F.expr(f"sequence(_part * {MANY}, least(_copies, (_part + 1) * {MANY}) - 1)")))
    return few.select("_row.*").unionByName(many.select("_row.*"))
