"""The engine's tables, built from the supplied parquet tables.

No deck files are supplied, so documents stand in for decks, conversations for deck versions,
events for clock ticks and region/nation/customer for the course tree (see the README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens.functions import numeric as N
from decklens.sources import slides as SL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.slides_from_documents(spread(documents(spark, sf_dir), "doc_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SL.slides_from_turns(table(spark, sf_dir, "conversations"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of fewer splits than cores one shuffle, so that later stages use all cores.

    Inputs with at least as many splits as cores (any real corpus) are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# --- judge answers derived from the documents -----------------------------------------------------
#
# For slide n of deck d, h = 7 d + 13 n picks the answer, so that every branch of the parser occurs:
# missing fields, missing and repeated slides, control characters, text around the JSON, broken JSON.


def judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(deck_id, response)``: one raw judge answer per document, built inside the document's row."""
    lines = F.size(SL.X.text_lines(F.col("text")))
    decks = spread(documents(spark, sf_dir), "doc_id").select(
        F.col("doc_id").alias("deck_id"), F.ceil(lines / SL.LINES_PER_SLIDE).cast("int").alias("n")
    )
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))

    def h(n):
        return F.col("deck_id") * 7 + n * 13

    def entry(n):
        return F.struct(
            n.alias("slide_number"),
            F.when(h(n) % 10 == 0, F.lit("Portada")).when(h(n) % 10 != 1, F.lit("contenido")).alias("tipo"),
            F.when(h(n) % 7 != 0, (h(n) % 19) / 2.0).alias("hss_score"),
            F.lit("Bien¦dicho").alias("hss_feedback"),
            F.when(h(n) % 5 != 0, (h(n) % 21) / 2.0).alias("nts_score"),
            F.when(h(n) % 3 != 0, F.lit("Sigue")).alias("nts_feedback"),
            F.when(h(n) % 4 != 0, (5 + h(n) % 60).cast("int")).alias("tiempo_estimado_segundos"),
        )

    def again(n):
        null = F.lit(None).cast
        return F.struct(
            n.alias("slide_number"), F.lit("contenido").alias("tipo"), F.lit(1.0).alias("hss_score"),
            null("string").alias("hss_feedback"), null("double").alias("nts_score"),
            null("string").alias("nts_feedback"), F.lit(99).alias("tiempo_estimado_segundos"),
        )

    answers = F.concat(
        F.transform(F.filter(numbers, lambda n: n % 9 != 8), entry),
        F.transform(F.filter(numbers, lambda n: n % 6 == 5), again),
    )
    body = F.regexp_replace(F.to_json(F.struct(answers.alias("diapositivas"))), "¦", "\n\t")
    whole = F.concat(F.lit("Aquí está la evaluación:\n"), body, F.lit("\nFin."))
    return decks.select(
        "deck_id",
        F.when(F.col("deck_id") % 17 == 0, F.lit("No puedo evaluar la presentación."))
        .when(F.col("deck_id") % 19 == 1, F.substring(whole, 1, 60))
        .otherwise(whole)
        .alias("response"),
    )


def restructure_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(deck_id, response)``: one raw rewriting answer per document."""
    lines = F.size(SL.X.text_lines(F.col("text")))
    decks = spread(documents(spark, sf_dir), "doc_id").select(
        F.col("doc_id").alias("deck_id"), F.ceil(lines / SL.LINES_PER_SLIDE).cast("int").alias("n")
    )
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))

    def generated(n):
        count = ((F.col("deck_id") + n) % 3).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(
            F.concat(F.lit("Título "), n.cast("string"), F.lit("."), i.cast("string")).alias("titulo_sugerido"),
            F.concat(F.lit("Texto de la opción "), i.cast("string"), F.lit(".")).alias("contenido_optimizado"),
            F.lit("definicion").alias("tipo_retorico_aplicado"),
        ))

    def entry(n):
        return F.struct(
            n.alias("slide_number"),
            F.array(F.concat(F.lit("¿Qué enseña la diapositiva "), n.cast("string"), F.lit("?"))).alias("preguntas"),
            F.when(n % 4 == 0, F.array(F.lit("Dato"))).otherwise(F.array().cast("array<string>")).alias("datos_curiosos"),
            generated(n).alias("diapositivas_generadas"),
        )

    body = F.to_json(F.transform(F.filter(numbers, lambda n: n % 7 != 6), entry))
    return decks.select(
        "deck_id",
        F.when(F.col("deck_id") % 17 == 0, F.lit("Sin respuesta"))
        .otherwise(F.concat(F.lit("Claro:\n"), body, F.lit("\n")))
        .alias("response"),
    )


# --- course tree ------------------------------------------------------------------------------------


def course_tables(spark: SparkSession, sf_dir: str):
    """Subjects, units, topics and subtopics: regions, nations, market segments, customers.

    Each region has a unit without topics, each nation a topic without subtopics.
    """
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    subjects = region.select(
        F.col("r_regionkey").cast("string").alias("subject_id"), F.col("r_name").alias("name"),
        (F.col("r_regionkey") % 2).cast("int").alias("active"),
    )
    units = nation.select(
        F.col("n_nationkey").cast("string").alias("unit_id"),
        F.col("n_regionkey").cast("string").alias("subject_id"),
        F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("number"),
    ).unionByName(region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("unit_id"),
        F.col("r_regionkey").cast("string").alias("subject_id"),
        F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).cast("int").alias("number"),
    ))
    topic_id = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment")
    topics = customer.select("c_nationkey", "c_mktsegment").distinct().select(
        topic_id.alias("topic_id"), F.col("c_nationkey").cast("string").alias("unit_id"),
        F.col("c_mktsegment").alias("name"), F.ascii("c_mktsegment").alias("number"),
    ).unionByName(nation.select(
        F.concat(F.col("n_nationkey").cast("string"), F.lit("/REPASO")).alias("topic_id"),
        F.col("n_nationkey").cast("string").alias("unit_id"), F.lit("REPASO").alias("name"), F.lit(0).alias("number"),
    ))
    subtopics = customer.select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subtopic_id"), topic_id.alias("topic_id"),
        F.col("c_name").alias("name"), F.col("c_custkey").alias("number"),
    )
    return subjects, units, topics, subtopics


# --- catalogue: each conversation is a deck, each turn one of its versions ---------------------------


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("deck_id"), (F.col("conv_id") % 5).cast("string").alias("subject_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("file_name"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    stem = F.concat(F.lit("p/"), c.cast("string"), F.lit("_v"), (t + 1).cast("string"))
    null = F.lit(None).cast
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", c.cast("string"), t.cast("string")).alias("version_id"), c.alias("deck_id"),
        (t + 1).cast("int").alias("version"), ((c + t) % 2).cast("int").alias("analysed"),
        F.date_add(F.lit("2024-01-01").cast("date"), t.cast("int")).alias("loaded"),
        (F.length("text") % 40).alias("total_slides"), F.sha2("text", 256).alias("hash"),
        F.concat(stem, F.lit(".pptx")).alias("path"), F.concat(stem, F.lit("_thumb.png")).alias("thumb_path"),
        F.when(t % 3 != 0, F.concat(stem, F.lit(".pdf"))).alias("pdf_path"),
        null("double").alias("score"), null("string").alias("zone"), null("string").alias("time_report"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).filter("analysed = 1").select(
        "version_id", F.lit(0).alias("slide_number"), F.concat(F.lit("old "), "version_id").alias("result")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks(spark, sf_dir).filter("deck_id % 3 = 0").select(
        "deck_id", F.concat(F.lit("s"), F.col("deck_id").cast("string")).alias("subtopic_id")
    )


def incoming_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files; one in 23 sizes stands for an unreadable file without slides."""
    lines = F.size(SL.X.text_lines(F.col("text")))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"), F.col("doc_id").alias("arrival"), F.col("n_chars").alias("length"),
        F.sha2("text", 256).alias("hash"),
        F.when(F.col("n_chars") % 23 == 0, F.lit(0)).otherwise(F.ceil(lines / 3)).cast("int").alias("total_slides"),
        (F.col("doc_id") % 6).cast("string").alias("subject_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pptx")).alias("file_name"),
    )


# --- class time: each event is one tick of the clock --------------------------------------------------


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 7).alias("deck_id"), F.col("event_type").alias("group"),
        F.date_format("ts", "yyyy-MM-dd").alias("session"), (F.col("user_id") % 20 + 1).cast("int").alias("slide"), "ts",
    )


def plans(tick_rows: DataFrame) -> DataFrame:
    """A plan per session, by rule; a few sessions have none."""
    day = F.dayofmonth(F.col("session").cast("date"))
    return tick_rows.select("deck_id", "group", "session").distinct().select(
        "*", ((F.col("deck_id") * 3 + day) % 13).cast("int").alias("planned")
    )


def times(tick_rows: DataFrame) -> DataFrame:
    """Real seconds per deck, group and slide; every 97th count stands for a page left at once."""
    counted = tick_rows.groupBy("deck_id", "group", "slide").agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("seen")
    )
    return counted.select(
        "deck_id", "group", "slide", F.when(F.col("n") % 97 == 0, F.lit(0)).otherwise(F.col("n")).alias("seconds"), "seen"
    )


def reference_times(tick_rows: DataFrame) -> DataFrame:
    """Recommended seconds of the analysed slides 1..18 of every deck (0 for slide 9)."""
    decks = tick_rows.select("deck_id").distinct()
    slide = F.explode(F.sequence(F.lit(1), F.lit(18))).alias("slide")
    seconds = F.when(F.col("slide") == 9, F.lit(0)).otherwise(10 + (F.col("slide") * 7 + F.col("deck_id")) % 30)
    return decks.select("deck_id", slide).withColumn("recommended", seconds.cast("int"))


# --- shapes: the block tags of a page ----------------------------------------------------------------

_BLOCK = r"(?is)<(?:h1|p|li|footer|div|nav)\b[^>]*>[^<]*"


def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slide per page: headings, paragraphs, list items and footers as text shapes, ads as
    pictures, navigation bars as tables; the place on the slide follows the place in the page.
    Headings of every second page stand in the title placeholder.

    The blocks of a page are named once: a filter on the shapes copies the whole expression, and a size taken
    inside it would read the page again for each block."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("deck_id"), "html")
    tag = lambda b: F.lower(F.regexp_extract(b, r"^<(\w+)", 1))

    def shape(b, i, kind, n):
        return F.struct(
            F.when(kind == "div", F.lit("PICTURE")).when(kind == "nav", F.lit("TABLE")).otherwise(F.lit("TEXT_BOX")).alias("shape_type"),
            ((kind == "h1") & (F.col("deck_id") % 2 == 0)).alias("is_title"),
            (kind == "h1").alias("is_placeholder"),
            F.lit(False).alias("has_image"),
            F.when(kind != "nav", F.concat(kind, F.lit(" "), i.cast("string"))).alias("name"),
            F.regexp_extract(b, r"(?s)>([^<]*)$", 1).alias("text"),
            F.floor(i * 100 / n).alias("top"),
            F.when(kind == "h1", F.array(F.lit(None).cast("int"), F.lit(32)))
            .when(kind == "p", F.array((i % 3 * 9).cast("int")))
            .otherwise(F.array().cast("array<int>")).alias("run_sizes"),
        )

    return pages.select(
        "deck_id", F.lit(1).alias("slide_number"), F.lit(100).cast("bigint").alias("slide_height"),
        N.let(
            F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(0)),
            lambda blocks: F.transform(blocks, lambda b, i: N.let(tag(b), lambda kind: shape(b, i, kind, F.size(blocks)))),
        ).alias("shapes"),
    )
