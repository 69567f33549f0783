"""Stored analyses: JSON text, one JSON file per version, CSV calibration reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens import schemas as S
from decklens.operators import calibrate as CAL
from decklens.session import scratch_folder
from decklens.sources.version_files import SUFFIX, VersionFiles, read_files


def parse_analysis(stored: DataFrame, column: str = "result", schema: T.StructType = S.ANALYSIS) -> DataFrame:
    """JSON text back to an ``analysis`` struct. Broken or missing text gives an empty document.

    A ``schema`` with fewer fields saves the parser the rest.
    """
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return stored.withColumn("analysis", parsed).drop(column)


def document_slides(documents: DataFrame) -> DataFrame:
    """One row per slide of parsed analyses, beside the deck totals; empty documents give none."""
    keys = [c for c in documents.columns if c != "analysis"]
    flat = documents.select(
        *keys,
        "analysis.total_diapositivas",
        "analysis.score_global_presentacion.*",
        "analysis.tiempo_total_exposicion_segundos",
        "analysis.tiempo_total_formateado",
        F.explode_outer("analysis.slides").alias("slide"),
    ).filter(F.col("slide").isNotNull())
    return flat.select(*[c for c in flat.columns if c != "slide"], "slide.*")


def stored_slides(stored: DataFrame, schema: T.StructType = S.ANALYSIS) -> DataFrame:
    return document_slides(parse_analysis(stored, schema=schema))


def write_analyses(stored: DataFrame, folder: str) -> None:
    """Analyses ``(path, result)`` as one UTF-8 file each, beside the path of its version: a deck at
    ``a/b_v2.pptx`` gives ``a/b_v2_analysis.json`` below ``folder``. Paths are expected to be unique.

    Files appear when all tasks have ended; an analysis that stands already is replaced.
    """
    spark = stored.sparkSession
    spark.dataSource.register(VersionFiles)
    stored.select("path", "result").write.format(VersionFiles.name()).mode("append").save(folder)


def read_analyses(spark, folder: str) -> DataFrame:
    """``(path, result)``: every analysis file below ``folder``, its path without the suffix."""
    files = read_files(spark, folder)
    return files.select(F.regexp_replace("path", f"{re.escape(SUFFIX)}$", "").alias("path"), F.col("content").cast("string").alias("result"))


def written_and_read(stored: DataFrame) -> DataFrame:
    """Write to a new shared folder and read back."""
    folder = scratch_folder(stored.sparkSession)
    write_analyses(stored, folder)
    return read_analyses(stored.sparkSession, folder)


def write_csv_report(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def csv_report(slides: DataFrame) -> DataFrame:
    """Per-slide calibration rows, written as CSV with a header and read back."""
    rows = CAL.calibration_rows(slides)
    folder = scratch_folder(slides.sparkSession)
    write_csv_report(rows, folder)
    return slides.sparkSession.read.schema(rows.schema).option("header", True).csv(folder)
