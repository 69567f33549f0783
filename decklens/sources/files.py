"""File listings, the size gate and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import numeric as N


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pptx", content: bool = False) -> DataFrame:
    """Files below ``folder``, one row each. Without ``content`` no file is opened.

    Spark leaves files of length 0 out of its listings; as decks they would be unreadable anyway.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return files if content else files.select("path", "length", "modificationTime")


def fingerprint(content: Column) -> Column:
    """SHA-256 of the content, in hex."""
    return F.sha2(content, 256)


def within_limit(length: Column, limit_mb: float = K.SIZE_LIMIT_MB) -> Column:
    """Whether a size in bytes passes; exactly the limit passes. Pushed down to the listing."""
    return length <= limit_mb * 1024 * 1024


def size_gate(files: DataFrame, limit_mb: float = K.SIZE_LIMIT_MB) -> DataFrame:
    """Add ``accepted`` and, for rejected files, ``message`` with the size."""
    head, middle, tail = K.SIZE_MESSAGE
    size = N.py_round(F.col("length") / (1024 * 1024), 2)
    return files.withColumn("accepted", within_limit(F.col("length"), limit_mb)).withColumn(
        "message",
        F.when(
            ~F.col("accepted"),
            F.concat(
                F.lit(head),
                F.call_function("format_number", size, F.lit("0.00")),
                F.lit(f"{middle}{limit_mb}{tail}"),
            ),
        ),
    )


def fingerprint_files(spark: SparkSession, folder: str, pattern: str = "*.pptx") -> DataFrame:
    """Accepted files with their hash. The size test reaches the scan, so a file over the limit is
    never read; the bytes themselves do not leave the scan stage."""
    files = scan_files(spark, folder, pattern, content=True)
    return files.filter(within_limit(F.col("length"))).select(
        "path", "length", fingerprint(F.col("content")).alias("hash")
    )
