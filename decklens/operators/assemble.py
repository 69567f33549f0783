"""Slides from shapes.

A slide row carries its shapes as an array in drawing order; every rule works inside the row, so
assembling needs no shuffle. A long table of shapes is gathered per slide first
(:func:`gather_shapes`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens import constants as K
from decklens.functions import text as X

_LEAF = ("shape_type", "is_title", "is_placeholder", "has_image", "name", "text", "top", "run_sizes")

# Fixed patterns of metadata texts: course words, dates, months, course codes, a three-word name.
FOOTER_PATTERNS = (
    X.whole_word(K.FOOTER_COURSE_WORDS),
    r"\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}",
    X.whole_word(K.FOOTER_MONTHS),
    r"(?<![\p{L}\p{N}_])[A-Z]{2,6}\p{Nd}{3,4}(?![\p{L}\p{N}_])",
    r"^[A-ZÁÉÍÓÚ][a-záéíóú]+ [A-ZÁÉÍÓÚ][a-záéíóú]+ [A-ZÁÉÍÓÚ][a-záéíóú]+$",
)


def _leaf(shape: Column) -> Column:
    return F.struct(*[shape[f].alias(f) for f in _LEAF])


def nesting(shapes: T.ArrayType) -> int:
    """Number of levels of ``children`` that an array of shapes has."""
    fields = {f.name: f.dataType for f in shapes.elementType.fields}
    return 1 + nesting(fields["children"]) if "children" in fields else 0


def flatten_shapes(slides: DataFrame, column: str = "shapes") -> DataFrame:
    """Slides whose nested shapes are replaced by their leaves, at whatever depth the schema has."""
    return slides.withColumn(column, flatten_groups(F.col(column), nesting(slides.schema[column].dataType)))


def leaf_rows(rows: DataFrame) -> DataFrame:
    """Shape rows of any depth to leaf rows for :func:`gather_shapes`.

    ``path`` (``array<int>``) holds the positions from the slide down to the shape. ``GROUP`` rows go;
    arrays compare entry by entry, so the path is the drawing order ``z``.
    """
    return rows.filter(~F.col("shape_type").eqNullSafe("GROUP")).withColumnRenamed("path", "z")


def flatten_groups(shapes: Column, depth: int) -> Column:
    """Leaf shapes in drawing order; a ``GROUP`` is replaced by its ``children``, an empty one by nothing.

    ``depth`` is the number of nesting levels the schema has (:func:`nesting`).
    """

    def expand(shape: Column, level: int) -> Column:
        if level == 0:
            return F.filter(F.array(_leaf(shape)), lambda s: ~s["shape_type"].eqNullSafe("GROUP"))
        inner = F.coalesce(F.flatten(F.transform(shape["children"], lambda child: expand(child, level - 1))), F.array())
        return F.when(shape["shape_type"] == "GROUP", inner).otherwise(F.array(_leaf(shape)))

    return F.flatten(F.transform(shapes, lambda s: expand(s, depth)))


def gather_shapes(rows: DataFrame) -> DataFrame:
    """Shape rows ``(deck_id, slide_number, z, slide_height, ...)`` to one row per slide.

    What is gathered is one slide, which ends up in one row in any case.
    """
    shape = F.struct("z", F.struct(*_LEAF).alias("s"))
    return rows.groupBy("deck_id", "slide_number", "slide_height").agg(
        F.array_sort(F.collect_list(shape)).alias("zs")
    ).select("deck_id", "slide_number", "slide_height", F.col("zs.s").alias("shapes"))


def is_image(shape: Column) -> Column:
    """Pictures, picture placeholders and tables; the text of a table is not read."""
    pictured = F.coalesce(shape["is_placeholder"], F.lit(False)) & F.coalesce(shape["has_image"], F.lit(False))
    return shape["shape_type"].isin(*K.IMAGE_SHAPE_TYPES) | pictured


def is_decorative_number(text: Column, name: Column, ratio: Column) -> Column:
    """One to three digits at the very top or bottom, or in a shape named as a page number."""
    named = F.lower(F.coalesce(name, F.lit("")))
    placed = (ratio < K.NUMBER_ZONE_ABOVE) | (ratio > K.NUMBER_ZONE_BELOW)
    return X.strip(text).rlike(r"^\p{Nd}{1,3}$") & (
        placed | F.contains(named, F.lit("slide number")) | F.contains(named, F.lit("page"))
    )


def is_footer(text: Column, words: Column, ratio: Column) -> Column:
    """Short or metadata-like text in the lowest quarter of the slide."""
    meta = text.rlike(FOOTER_PATTERNS[0])
    for pattern in FOOTER_PATTERNS[1:]:
        meta = meta | text.rlike(pattern)
    return (ratio >= K.FOOTER_ZONE_FROM) & (
        ((ratio >= K.FOOTER_LOW_FROM) & (words <= K.FOOTER_LOW_WORDS))
        | (words <= K.FOOTER_SHORT_WORDS)
        | ((words <= K.FOOTER_META_WORDS) & meta)
    )


def first_font_size(run_sizes: Column) -> Column:
    """First explicit font size, else 0."""
    return F.coalesce(F.get(F.filter(run_sizes, lambda x: x > 0), 0), F.lit(0))


def _read(shape: Column, height: Column) -> Column:
    """A shape with its cleaned text and vertical position."""
    return F.struct(
        shape["name"].alias("name"),
        X.clean_text(F.coalesce(shape["text"], F.lit(""))).alias("text"),
        shape["top"].alias("top"),
        F.try_divide(shape["top"], height).alias("ratio"),
        F.coalesce(shape["is_title"], F.lit(False)).alias("is_title"),
        is_image(shape).alias("image"),
        first_font_size(shape["run_sizes"]).alias("size"),
    )


def _with_role(r: Column, title: Column) -> Column:
    words = X.plain_word_count(r["text"])
    role = (
        F.when(r["image"], F.lit("image"))
        .when((r["text"] == "") | (r["text"] == title), F.lit("skip"))
        .when(is_decorative_number(r["text"], r["name"], r["ratio"]), F.lit("skip"))
        .when(is_footer(r["text"], words, r["ratio"]), F.lit("footer"))
        .when((title == "") & (r["ratio"] < K.TITLE_ZONE_BELOW), F.lit("candidate"))
        .otherwise(F.lit("content"))
    )
    return F.struct(role.alias("role"), r["text"].alias("text"), r["name"].alias("name"), r["size"].alias("size"), r["top"].alias("top"))


def assemble_slides(slides: DataFrame) -> DataFrame:
    """Title, content, footer and images of each slide from ``shapes`` and ``slide_height``.

    A title placeholder with text gives the title. Otherwise text near the top competes for it:
    the largest font wins, then the highest place, then drawing order; it becomes the title when
    short enough, and what is left of the candidates follows the content in rank order.
    """
    read = slides.withColumn("_read", F.transform("shapes", lambda s: _read(s, F.col("slide_height"))))
    own = F.get(F.filter("_read", lambda r: r["is_title"]), 0)
    own_title = F.when(
        ~is_decorative_number(own["text"], own["name"], own["ratio"]), own["text"]
    )
    titled = read.withColumn("_title", F.coalesce(own_title, F.lit("")))
    roles = titled.withColumn("_roles", F.transform("_read", lambda r: _with_role(r, F.col("_title"))))

    def having(role: str) -> Column:
        return F.filter("_roles", lambda r: r["role"] == role)

    ranked = F.array_sort(F.transform(
        having("candidate"),
        lambda r, i: F.struct((-r["size"]).alias("a"), r["top"].alias("b"), i.alias("c"), r["text"].alias("text")),
    ))
    placed = roles.withColumn("_ranked", F.transform(ranked, lambda r: r["text"])).withColumn(
        "_best", F.get("_ranked", 0)
    ).withColumn(
        "_short",
        F.coalesce(
            (F.length("_best") <= K.TITLE_MAX_CHARS) & ~X.has_words(F.col("_best"), K.TITLE_MAX_WORDS + 1),
            F.lit(False),
        ),
    )
    body = F.transform(having("content"), lambda r: r["text"])
    rest = F.when(F.col("_short"), F.slice("_ranked", 2, F.greatest(F.size("_ranked"), F.lit(1)))).otherwise(F.col("_ranked"))
    images = F.transform(having("image"), lambda r: F.coalesce(r["name"], F.lit("Tabla_o_Imagen")))
    built = placed.select(
        "deck_id", "slide_number",
        F.when(F.col("_short"), F.col("_best")).otherwise(F.col("_title")).alias("title"),
        F.concat(body, rest).alias("content"),
        F.transform(having("footer"), lambda r: r["text"]).alias("footer"),
        images.alias("images"),
    )
    return built.withColumns({
        "image_count": F.size("images"),
        "image_only": (F.size("content") == 0) & (F.col("title") == "") & (F.size("images") > 0),
    })
