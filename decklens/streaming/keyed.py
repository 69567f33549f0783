"""Tables that follow a stream: an append-only log of its rows, and results replaced by key.

Both are cut into parts by a value that follows from the key (a day, a hash bucket), so that all of
a key lies in one part. A batch is logged under its number; results are then computed again for the
keys it touched, by the batch operators, and only their parts are replaced. Late rows are rows of
a touched key like others, a repeated batch replaces what it wrote, and no state is kept elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def hash_part(keys: list[str], parts: int = 64) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Keyed:
    """The log and the result tables below ``folder``, for rows with ``keys``; ``part`` is an expression of the keys."""

    spark: SparkSession
    folder: str
    keys: list[str]
    part: Column

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", self.part.cast("string"))

    def _present(self, name: str) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
            return rows.withColumn("part", F.col("part").cast("string")) if "part" in rows.columns else rows
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Log a batch under its number; returns its touched keys."""
        place = f"{self.folder}/log/batch={batch_id}"
        self._placed(rows).write.mode("overwrite").partitionBy("part").parquet(place)
        logged = self.spark.read.schema(self._placed(rows).schema).parquet(place)
        return logged.select(*self.keys, "part").distinct()

    def logged(self, touched: DataFrame | None = None) -> DataFrame | None:
        """Rows of the log; of ``touched`` keys only, from their parts."""
        rows = self._present("log")
        if rows is None or touched is None:
            return rows
        return rows.filter(F.col("part").isin(_parts(touched))).join(touched.select(*self.keys), self.keys, "left_semi").drop("part", "batch")

    def read(self, name: str) -> DataFrame | None:
        return self._present(name)

    def replace(self, name: str, fresh: DataFrame, touched: DataFrame) -> None:
        """Rows of the ``touched`` keys in table ``name`` become ``fresh``; other parts keep their files."""
        parts = _parts(touched)
        rows = self._placed(fresh.select(*fresh.columns))
        before = self._present(name)
        if before is not None:
            kept = before.filter(F.col("part").isin(parts)).join(touched.select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(kept.select(*rows.columns))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")


def _parts(touched: DataFrame) -> list[str]:
    """Parts of the touched keys: at most as many as there are parts."""
    return [r.part for r in touched.select(F.col("part").cast("string").alias("part")).distinct().collect()]
