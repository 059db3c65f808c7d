"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.sources.sinks import stage_path

#: The words of most contracts: runs of anything but ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package.

    On a cluster the package is installed or sent along with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


class Stored:
    """An intermediate in the shared scratch folder that can be removed when nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        self._spark, self._path = df.sparkSession, stage_path(df.sparkSession, label)
        df.write.parquet(self._path)
        self.frame = self._spark.read.schema(df.schema).parquet(self._path)

    def discard(self) -> None:
        """Only after everything made of it is written: no lost task may have to read it again."""
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """Exclusive running sums of an array of longs.

    Sums are built chunk by chunk and shifted by the chunks before, so that a
    row with very many values does not copy a long array once for each.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))

    def step(size):
        return lambda state, x: F.struct(
            (state["at"] + size(x)).alias("at"),
            F.concat(state["out"], F.array(state["at"])).alias("out"),
        )

    last = F.floor((F.size(values) - 1) / chunk).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * chunk + 1, chunk))
    sums = F.transform(chunks, lambda part: F.aggregate(part, start, step(lambda x: x)))
    shifted = let(
        sums,
        lambda s: let(
            F.aggregate(s, start, step(lambda x: x["at"]))["out"],
            lambda base: F.flatten(
                F.transform(s, lambda part, k: F.transform(part["out"], lambda x: x + F.get(base, k)))
            ),
        ),
    )
    return F.when(F.size(values) > 0, shifted).otherwise(F.array().cast("array<long>"))
