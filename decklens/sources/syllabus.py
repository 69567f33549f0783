"""Course trees: from a plain JSON map, and from the authored nested form into four tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens import schemas as S


def read_syllabus_map(spark: SparkSession, path: str) -> DataFrame:
    """``{unit: {"1.1": topic, "2.2.1": subtopic}}`` files as ``(path, syllabus)`` rows."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", F.from_json("value", S.SYLLABUS_MAP).alias("syllabus"))


def syllabus_map_rows(maps: DataFrame, key: str = "path") -> DataFrame:
    """One row per entry: unit, number, name and level (1 topic, 2 subtopic, by dots)."""
    units = maps.select(key, F.explode("syllabus").alias("unit", "entries"))
    return units.select(key, "unit", F.explode("entries").alias("number", "name")).withColumn(
        "level", F.length("number") - F.length(F.replace(F.col("number"), F.lit("."), F.lit("")))
    )


def _id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def load_syllabus(nested: DataFrame, subjects: DataFrame):
    """``(subjects, units, topics, subtopics)`` rows to append for authored course trees.

    A subject whose name is stored already is skipped whole; of several trees of one name, the
    first by content is loaded. Ids are hashes of the path of names
    and numbers, so loading twice gives the same rows.
    """
    fresh = nested.join(
        subjects.select(F.col("name").alias("unidad_aprendizaje")), "unidad_aprendizaje", "left_anti"
    ).groupBy("unidad_aprendizaje").agg(F.min("unidades").alias("unidades"))
    new = fresh.select(
        _id("unidad_aprendizaje").alias("subject_id"), F.col("unidad_aprendizaje").alias("name"), "unidades"
    )
    u = new.select("subject_id", F.explode("unidades").alias("u")).select(
        _id("subject_id", F.col("u.numero").cast("string"), "u.nombre").alias("unit_id"), "subject_id",
        F.col("u.nombre").alias("name"), F.col("u.numero").alias("number"), F.col("u.temas").alias("temas"),
    )
    t = u.select("unit_id", F.explode("temas").alias("t")).select(
        _id("unit_id", F.col("t.numero").cast("string"), "t.nombre").alias("topic_id"), "unit_id",
        F.col("t.nombre").alias("name"), F.col("t.numero").alias("number"), F.col("t.subtemas").alias("subtemas"),
    )
    s = t.select("topic_id", F.explode("subtemas").alias("s")).select(
        _id("topic_id", F.col("s.numero").cast("string"), "s.nombre").alias("subtopic_id"), "topic_id",
        F.col("s.nombre").alias("name"), F.col("s.numero").alias("number"),
    )
    return (
        new.select("subject_id", "name", F.lit(1).alias("active")),
        u.drop("temas"),
        t.drop("subtemas"),
        s,
    )
