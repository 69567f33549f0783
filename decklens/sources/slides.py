"""Slide tables: from deck extracts, and from plain documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens import constants as K
from decklens import schemas as S
from decklens.functions import text as X

LINES_PER_SLIDE = 3


def read_decks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Deck extracts, one row per deck, with the fixed schema (nothing is inferred)."""
    return spark.read.schema(S.DECK_EXTRACT).format(fmt).load(path)


def slides_of(decks: DataFrame) -> DataFrame:
    """One row per slide. A slide without a number takes its place in the list."""
    empty = F.array().cast("array<string>")
    flat = decks.select("deck_id", F.posexplode("slides").alias("place", "s"))
    return flat.select(
        "deck_id",
        F.coalesce("s.slide_number", F.col("place") + 1).alias("slide_number"),
        F.coalesce("s.title", F.lit("")).alias("title"),
        F.coalesce("s.content", empty).alias("content"),
        F.coalesce("s.footer", empty).alias("footer"),
        F.coalesce("s.image_count", F.size(F.coalesce("s.images", empty)), F.lit(0)).alias("image_count"),
        F.coalesce("s.image_only", F.lit(False)).alias("image_only"),
    )


def read_slides(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return slides_of(read_decks(spark, path, fmt))


def slides_from_documents(
    documents: DataFrame, deck: str = "doc_id", text: str = "text", per_slide: int = LINES_PER_SLIDE
) -> DataFrame:
    """Read running text as a deck: every ``per_slide`` non-blank lines make a slide.

    The first line is the title when it is short enough to be one. The rows are made inside the
    scan stage, so a text of any length needs no shuffle. (The outer form of explode keeps the
    optimizer from adding a filter that would split every text a second time.)
    """
    lines = documents.select(F.col(deck).alias("deck_id"), X.text_lines(F.col(text)).alias("lines"))
    starts = F.when(
        F.size("lines") > 0,
        F.sequence(F.lit(1), F.size("lines"), F.lit(per_slide)),
    ).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(F.col("lines"), i, F.lit(per_slide)))
    cut = (
        lines.select("deck_id", blocks.alias("blocks"))
        .select("deck_id", F.posexplode_outer("blocks").alias("place", "block"))
        .filter(F.col("block").isNotNull())
        .select("deck_id", (F.col("place") + 1).alias("slide_number"), "block")
    )
    first = F.element_at("block", 1)
    titled = cut.withColumn(
        "has_title",
        (F.length(first) <= K.TITLE_MAX_CHARS) & ~X.has_words(first, K.TITLE_MAX_WORDS + 1),
    )
    rest = F.slice("block", 2, per_slide)
    return titled.select(
        "deck_id",
        "slide_number",
        F.when(F.col("has_title"), first).otherwise(F.lit("")).alias("title"),
        F.when(F.col("has_title"), rest).otherwise(F.col("block")).alias("content"),
        F.array().cast("array<string>").alias("footer"),
        F.lit(0).alias("image_count"),
        F.lit(False).alias("image_only"),
    )


def slides_from_turns(turns: DataFrame) -> DataFrame:
    """Read a conversation as a deck: each turn is a slide without a title (numbered from 1)."""
    return turns.select(
        F.col("conv_id").alias("deck_id"),
        (F.col("turn") + 1).cast("int").alias("slide_number"),
        F.lit("").alias("title"),
        F.array("text").alias("content"),
        F.array().cast("array<string>").alias("footer"),
        F.lit(0).alias("image_count"),
        F.lit(False).alias("image_only"),
    )


def slide_count(slides: DataFrame) -> DataFrame:
    """Slides per deck."""
    return slides.groupBy("deck_id").agg(F.count(F.lit(1)).alias("total_slides"))


def without_slides(decks: DataFrame, counts: DataFrame) -> DataFrame:
    """Decks to reject: unreadable or empty, i.e. with no slide."""
    return decks.join(counts.filter("total_slides > 0"), "deck_id", "left_anti")
