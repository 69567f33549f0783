"""Corpus quartiles used to calibrate thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from decklens.functions import numeric as N
from decklens.functions import text as X
from decklens.operators import metrics as M

WORDS_MIN = 5
METRIC_WORDS_MIN = 10
METRIC_TOKENS_MIN = 5

#: distinct values per bucket of the two-level search
BUCKET = 1024


def exclusive_quartiles(rows: DataFrame, scale: int) -> DataFrame:
    """Quartiles of ``rows(metric, v)`` at positions ``i * (n + 1) / 4``, interpolated.

    ``v`` must be a multiple of ``1 / scale``; nulls do not count. Exact, without sorting the corpus: values are
    counted per distinct value (partial counts before the shuffle), counts are summed per bucket
    of 1024 neighbouring values, the few bucket totals are accumulated to find the buckets that
    hold the wanted ranks, and only those buckets are looked into. No window sees more than the
    bucket totals of one metric or the distinct values of one bucket.
    """
    return quartiles_of_counts(value_counts(rows, scale), scale)


def value_counts(rows: DataFrame, scale: int) -> DataFrame:
    """``(metric, tick, n)``: how often each value of ``rows(metric, v)`` occurs, as a whole number of ``1 / scale``.

    This is all that quartiles need to know of a corpus, and it can be kept: see :func:`merged_counts`.
    """
    ticks = rows.groupBy("metric", F.rint(F.col("v") * scale).cast("bigint").alias("tick"))
    return ticks.agg(F.count("v").alias("n")).filter("n > 0")


def merged_counts(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Kept counts with those of new decks added and those of deleted decks taken off.

    Only the slides that come or go are read for it. A count that would fall below 0 shows that rows were removed that had
    never been added: an error.
    """
    parts = state.select("metric", "tick", "n")
    if added is not None:
        parts = parts.unionByName(added.select("metric", "tick", "n"))
    if removed is not None:
        parts = parts.unionByName(removed.select("metric", "tick", (-F.col("n")).alias("n")))
    sums = parts.groupBy("metric", "tick").agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("values were removed that had not been counted")).cast("bigint")).otherwise(F.col("n"))
    return sums.select("metric", "tick", checked.alias("n")).filter("n > 0")


def quartiles_of_counts(state: DataFrame, scale: int) -> DataFrame:
    """:func:`exclusive_quartiles` from counts of values ``(metric, tick, n)``."""
    counts = state.withColumn("bucket", F.floor(F.col("tick") / BUCKET))
    by_bucket = counts.groupBy("metric", "bucket").agg(
        F.sum("n").alias("n"), F.min("tick").alias("low"), F.max("tick").alias("high")
    )
    metric = Window.partitionBy("metric")
    placed = by_bucket.select(
        "metric", "bucket",
        F.sum("n").over(metric.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.col("n").alias("inside"),
        F.sum("n").over(metric).alias("size"),
        (F.min("low").over(metric) / scale).alias("lowest"),
        (F.max("high").over(metric) / scale).alias("highest"),
    ).withColumn("before", F.coalesce("before", F.lit(0))).filter("size >= 2")

    def left_rank(i: int) -> Column:
        spot = F.floor((F.col("size") + 1) * i / 4)
        return F.greatest(F.lit(1), F.least(F.col("size") - 1, spot)).cast("bigint")

    ranks = F.array(*[left_rank(i) + k for i in (1, 2, 3) for k in (0, 1)])
    wanted = placed.withColumn("ranks", ranks).filter(
        F.exists("ranks", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("inside")))
    )
    # Null-safe keys add no filter to either side, so that both sides remain the same aggregate
    # and the corpus is counted once (its shuffle is reused).
    c, w = counts.alias("c"), wanted.alias("w")
    same = F.col("c.metric").eqNullSafe(F.col("w.metric")) & F.col("c.bucket").eqNullSafe(F.col("w.bucket"))
    inside = c.join(w, same).select("c.*", "w.before", "w.size", "w.lowest", "w.highest", "w.ranks")
    in_bucket = Window.partitionBy("metric", "bucket").orderBy("tick").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = inside.withColumn("upto", F.col("before") + F.sum("n").over(in_bucket))

    def at(index: int) -> Column:
        rank = F.element_at("ranks", index)
        hit = (F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto"))
        return F.max(F.when(hit, F.col("tick") / scale))

    found = reached.groupBy("metric", "size", "lowest", "highest").agg(
        *[at(2 * i + k + 1).alias(f"v{i}{k}") for i in range(3) for k in (0, 1)],
        F.first("ranks").alias("ranks"),
    )

    def quartile(i: int) -> Column:
        shift = (F.col("size") + 1) * i - F.element_at("ranks", 2 * i - 1) * 4
        low, high = F.col(f"v{i - 1}0"), F.col(f"v{i - 1}1")
        return N.py_round((low * (4 - shift) + high * shift) / 4, 2)

    return found.select(
        "metric", F.col("size").alias("sample_size"), quartile(1).alias("q1"),
        quartile(2).alias("median"), quartile(3).alias("q3"), "lowest", "highest",
    )


def word_values(slides: DataFrame) -> DataFrame:
    """``(metric, v)``: body words of slides with at least 5 of them.

    Shorter slides get a null value instead of being filtered: a filter on the count would be
    pushed below it and count the words of every slide twice.
    """
    words = X.word_count(X.body_text(F.col("content")))
    usable = N.let(words, lambda n: F.when(n >= WORDS_MIN, n.cast("double")))
    return slides.select(F.lit("palabras").alias("metric"), usable.alias("v"))


def word_calibration(slides: DataFrame) -> DataFrame:
    """Quartiles of body words over slides with at least 5 of them."""
    return exclusive_quartiles(word_values(slides), 1)


def _calibration_metrics(slides: DataFrame) -> DataFrame:
    m = (
        slides.transform(M.with_text).transform(M.with_counts)
        .transform(M.with_readability).transform(M.with_density)
    )
    return m.select(
        "deck_id", "slide_number", "words",
        N.py_round(F.col("syllables_per_word_raw"), 2).alias("silabas_por_palabra"),
        N.py_round(F.col("words_per_sentence_raw"), 2).alias("palabras_por_frase"),
        N.py_round(F.col("fsz_raw"), 2).alias("fsz"),
        F.col("dl"),
        ((F.col("words") >= METRIC_WORDS_MIN) & (F.col("tokens") >= METRIC_TOKENS_MIN)).alias("usable"),
    )


def calibration_rows(slides: DataFrame) -> DataFrame:
    """Unclamped readability, density and their parts per slide, 2 decimals."""
    return _calibration_metrics(slides).filter("usable").drop("usable")


def metric_values(slides: DataFrame) -> DataFrame:
    """``(metric, v)`` of the four calibration metrics (unusable slides count as null)."""
    names = ["fsz", "dl", "palabras_por_frase", "silabas_por_palabra"]
    return _calibration_metrics(slides).select(
        *[F.when(F.col("usable"), F.col(n)).alias(n) for n in names]
    ).unpivot([], names, "metric", "v")


def metric_calibration(slides: DataFrame) -> DataFrame:
    """Quartiles of the four calibration metrics."""
    return exclusive_quartiles(metric_values(slides), 100)
